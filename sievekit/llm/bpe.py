"""Byte-level BPE encoding and decoding by a distinct-word shuffle."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm import textscan, wordblocks
from sievekit.llm.common import gather_ranges, pack, texts, unpack


def load_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a line for each token, its bytes in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def _scan(data: np.ndarray, offs: np.ndarray):
    return data, *textscan.pretoken_starts(data, offs, joined_space=True)


_encoders: dict[int, object] = {}


def _encoder(content: bytes):
    """The library's encoder, once a worker."""
    key = hash(content)
    if key not in _encoders:
        import tiktoken
        from public_tokenizers import PATTERN

        _encoders[key] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=load_ranks(content), special_tokens={})
    return _encoders[key]


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: every whole text by the rank file, as tiktoken's encode_ordinary gives it.

    Pre-tokens are found with their positions, each distinct one is encoded once in the task of its bucket,
    and its ids are joined back to the blocks that hold it, where the positions put them in order.
    One row comes out for each row that goes in, repeated rows and null ids included; a null or empty text
    has no ids, other columns are ignored, an empty table gives an empty table.  A text may be of any length
    that one task can hold.  The documents must read the same twice (see wordblocks).
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())  # one fixed file, under 1 MB
    rows = texts(docs, id_col, text_col)
    buckets, tasks = wordblocks.sizes(rows)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_piece, now, known = _encoder(content.value)._encode_single_piece, None, {}
        for batch in batches:
            replies, sizes = [], []
            for bucket, count, size, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "size", "words"))):
                if bucket != now:
                    now, known = bucket, {}
                found = []
                for word in wordblocks.words_of(count, size, packed):
                    if (ids := known.get(word)) is None:
                        ids = known[word] = np.array(one_piece(word), np.uint32)
                    found.append(ids)
                size, reply = pack(np.fromiter(map(len, found), np.uint32, count), np.concatenate(found))
                replies.append(reply)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), batch.column("guard"), batch.column("n"), pa.array(sizes, pa.int32()), pa.array(replies, pa.binary())], names=["block", "bucket", "guard", "n", "size", "reply"])

    def finish(replies: pa.Table):
        lengths, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for count, size, reply in zip(*(replies.column(c).to_pylist() for c in ("n", "size", "reply"))):
            raw = np.frombuffer(unpack(size, reply), np.uint32)
            lengths.append(raw[:count])
            ids.append(raw[count:])
        length, flat = np.concatenate(lengths).astype(np.int64), np.concatenate(ids).astype(np.int32)
        start = np.cumsum(length) - length

        def chunk(doc_ids: pa.Array, words: np.ndarray, numbers: np.ndarray) -> pa.Table:
            sizes = length[numbers]
            out = flat[gather_ranges(start[numbers], sizes)]
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(words)]
            return pa.table({"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out, pa.int32()))})

        return chunk

    found = wordblocks.word_rows(rows, _scan, buckets).drop("counted")
    answers = wordblocks.by_bucket(found, tasks).mapInArrow(answer, "block long, bucket int, guard long, n int, size int, reply binary")
    return wordblocks.meet(wordblocks.span_rows(rows, _scan, buckets), answers, tasks, finish, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with a binary column more: the bytes of the ids, by a map-side join with the token-byte table.

    The table is the rank file's, of fixed size.  Null ids count as none; an id that the table lacks, or a null
    id, stops the job, as it stops the library.
    """
    spark = encoded.sparkSession
    with open(ranks_path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sorted((rank, token) for token, rank in load_ranks(content.value).items())
        length = np.zeros(tokens[-1][0] + 1, np.int64) if tokens else np.zeros(0, np.int64)
        for rank, token in tokens:
            length[rank] = len(token)
        start, flat = np.cumsum(length) - length, np.frombuffer(b"".join(token for _, token in tokens), np.uint8)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = column.flatten().to_numpy(zero_copy_only=False)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(length) or not length[ids].all()):
                raise ValueError("an id isn't in the token table")
            parts = []
            for lo in range(0, len(ids), 1 << 19):
                some = ids[lo : lo + (1 << 19)]
                parts.append(flat[gather_ranges(start[some], length[some])])
            ends = np.concatenate([[0], np.cumsum(length[ids])])[np.concatenate([[0], np.cumsum(sizes)])]
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.concatenate(parts) if parts else np.zeros(0, np.uint8))])
            yield pa.RecordBatch.from_arrays([*batch.columns, out.cast(pa.binary())], names=[*batch.schema.names, out_col])

    schema = encoded.withColumn(out_col, F.lit(b"")).schema
    return encoded.mapInArrow(run, schema)


def digests(documents: DataFrame, ranks_path: str) -> DataFrame:
    """Per document: how many ids, SHA-256 of the ids in decimal, SHA-256 of the decoded bytes."""
    done = decode(encode(documents, ranks_path), ranks_path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
