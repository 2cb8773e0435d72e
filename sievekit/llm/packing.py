"""Sum-of-squares packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm import textscan
from sievekit.llm.common import gather_ranges, texts

#: Documents that one task packs; each such shard leaves a few sequences open at its end.
SHARD_DOCUMENTS = 60_000
#: Distinct words whose ids a worker keeps.
CACHE_WORDS = 250_000

PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECES_SCHEMA + ", sequence_id long, offset long"

# Characters for which lower-casing and normalising go character by character without changing the
# length in UTF-8; a text with any other goes through the tokenizer as a whole.
_PLAIN_LIMIT = 0x250
_PLAIN = np.ones(_PLAIN_LIMIT + 1, bool)
_PLAIN[[0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x130, 0x23A, 0x23E, _PLAIN_LIMIT]] = False


class WordTokenizer:
    """A tokenizer file of the tokenizers library whose words end in marked pieces; keeps the ids of words seen.

    Pre-tokens of plain texts are found by textscan, and the library encodes those that are new, many in a call:
    the mark at the end of each word tells their ids apart.
    """

    def __init__(self, content: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(content)
        self.whole.encode_special_tokens = True  # such strings in a text are ordinary text
        vocabulary = self.whole.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start, self.length, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32), 0

    def _ids(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _learn(self, keys: list[bytes]) -> None:
        if len(self.known) + len(keys) > CACHE_WORDS and self.known:
            raise OverflowError
        for lo in range(0, len(keys), 1000):
            some = [k.decode("utf-8") for k in keys[lo : lo + 1000]]
            ids = np.array(self._ids(" ".join(some)), np.int32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(some):
                each = [self._ids(w) for w in some]
                ids = np.array([i for x in each for i in x], np.int32)
                ends = np.cumsum([len(x) for x in each])
            lengths = np.diff(ends, prepend=0)
            n, first = len(some), len(self.known)
            while first + n > len(self.start):
                self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.start[first : first + n] = self.used + ends - lengths
            self.length[first : first + n] = lengths
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.known.update(zip(keys[lo : lo + 1000], range(first, first + n)))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a chunk, one after another, and how many each row has."""
        n = len(offs) - 1
        points, at = textscan.code_points(data)
        odd = np.concatenate([[0], np.cumsum(~_PLAIN[np.minimum(points, _PLAIN_LIMIT)])])[np.searchsorted(at, offs)]
        plain = np.diff(odd) == 0
        if plain.all():
            return self._encode_plain(data, offs)
        kept = np.flatnonzero(plain)
        sizes = np.diff(offs)
        ids, counts = self._encode_plain(data[gather_ranges(offs[kept], sizes[kept])], np.concatenate([[0], np.cumsum(sizes[kept])]))
        ends = np.cumsum(counts)
        parts, out, k = [], np.zeros(n, np.int64), 0
        for i in range(n):
            if plain[i]:
                parts.append(ids[ends[k] - counts[k] : ends[k]])
                k += 1
            else:
                parts.append(np.array(self._ids(data[offs[i] : offs[i + 1]].tobytes().decode("utf-8")), np.int32))
            out[i] = len(parts[-1])
        return np.concatenate(parts), out

    def _encode_plain(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lowered = np.frombuffer(data.tobytes().decode("utf-8").lower().encode("utf-8"), np.uint8)
        starts, ends, rows = textscan.pretoken_starts(lowered, offs, joined_space=False)
        codes, first, _ = textscan.distinct(lowered, starts, ends)
        raw = lowered.tobytes()
        keys = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
        new = [k for k in keys if k not in self.known]
        if new:
            try:
                self._learn(new)
            except OverflowError:
                self._forget()
                self._learn(keys)
        place = np.array([self.known[k] for k in keys], np.int64)[codes] if keys else np.zeros(0, np.int64)
        lengths = self.length[place]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[gather_ranges(self.start[place], lengths)], np.diff(total[rows])


_tokenizers: dict[int, WordTokenizer] = {}


def tokenizer(content: str) -> WordTokenizer:
    key = hash(content)
    if key not in _tokenizers:
        _tokenizers[key] = WordTokenizer(content)
    return _tokenizers[key]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids and the end id, cut into pieces of `capacity`; only the last may be shorter.

    A null or empty text is one piece that holds the end id alone.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # one fixed file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(content.value)
        for batch in batches:
            data, offs = textscan.buffer_of(batch.column(1))
            ids = batch.column(0)
            for lo, hi in textscan.row_chunks(offs):
                flat, counts = words.encode(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                flat = flat.astype("<u4")
                out, at = [], 0
                for k, n in enumerate(counts.tolist()):
                    own = np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for p, s in enumerate(range(0, n + 1, capacity)):
                        some = own[s : s + capacity]
                        out.append((lo + k, p, s, len(some), zlib.crc32(some.tobytes())))
                row, piece, start, length, crc = zip(*out)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs, id_col, text_col).mapInArrow(run, PIECES_SCHEMA)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each item.

    Longest first, an item goes into that open bin for which the sum over all gaps of the squared number of
    open bins with that gap becomes smallest; a bin is opened where the item fits into none (the plain rule, by which an
    opening competes with the open bins, needs more bins: 4551 and not 4539, the least there can be, on the documents of sf0.1).
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    standing: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        rest = np.flatnonzero(count[size:])  # the gaps that would be left
        if len(rest):
            # count[gap] falls and count[rest] rises by one; a full bin counts no more
            change = np.where(rest > 0, count[rest], 0) - count[rest + size] - 0.5 * (rest == 0)
            left = int(rest[change.argmin()])
            gap = left + size
            bin_ = standing[gap].pop()
            count[gap] -= 1
        else:
            gap, left, bin_ = capacity, capacity - size, made
            made += 1
        bins[i], offsets[i] = bin_, capacity - gap
        if left:
            count[left] += 1
            standing[left].append(bin_)
    return bins, offsets


def pack_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, shard_documents: int = SHARD_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: documents packed into sequences of at most `capacity` ids.

    Pieces are dealt at random over shards of about `shard_documents` documents, and a shard is packed by one
    task; so shards grow in number and not in size, and each adds about one sequence to what packing all at once
    would need.  One or more rows come out for each row that goes in: repeated rows are packed again, null ids
    are kept, a null or empty text is the end id alone, ties go to the piece that comes first in its shard's
    order, other columns are ignored, an empty table gives an empty table.
    """
    rows = pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col)
    shards = max(1, -(-docs.count() // shard_documents))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "length")])
        bins, offsets = sum_of_squares(group.column("length").to_numpy(), capacity)
        out = group.drop_columns(["shard"])
        return out.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInArrow(run, PACKED_SCHEMA)
