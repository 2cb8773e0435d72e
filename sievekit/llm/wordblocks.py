"""The distinct-word shuffle: whole documents meet something known once per distinct word.

A block is a run of documents of one input partition, a few MB of text.  Of each block only its distinct
words (told apart by their bytes) travel, packed by word bucket, so a frequent word is one entry a block however often it occurs.
The task of a bucket sees each word of the whole corpus that falls into it, answers every block with one
value (or list) per word, and the answers meet the block's sequence of word numbers again by block.

Both passes read the documents, so these must give the same rows in the same order when read again, as a
table does; a guard over each block's words stops the job if they don't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm import textscan
from sievekit.llm.common import gather_ranges, pack, partitions, unpack

#: Bytes of text of a block.
BLOCK_BYTES = 8 << 20

WORDS_SCHEMA = "bucket int, block long, guard long, n int, size int, words binary, counted binary"
SPANS_SCHEMA = "block long, part int, guard long, doc_ids array<long>, lengths binary, size int, numbers binary"

#: Bytes of text for each task of a shuffle, and word buckets for each task.
TASK_BYTES, BUCKETS = 32 << 20, 8


def sizes(rows: DataFrame) -> tuple[int, int]:
    """Word buckets and tasks for the texts of `rows` (doc_id, text): both in proportion to their bytes, so neither a bucket nor a task grows with the corpus."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(partitions(rows.sparkSession), -(-total // TASK_BYTES))
    return BUCKETS * tasks, tasks


Scan = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


class _Block:
    """The distinct words of some documents, by their bytes, and the numbers of all their words."""

    def __init__(self) -> None:
        self.bytes = self.count = 0
        self.chunks: list[tuple] = []
        self.words: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, ids: pa.Array, data: np.ndarray, offs: np.ndarray, scan: Scan, weight: np.ndarray | None) -> None:
        """Of a chunk only the distinct words are kept, one behind another; its words have their places there until close()."""
        data, starts, ends, rows = scan(data, offs)
        codes, first, _ = textscan.distinct(data, starts, ends)
        size = (ends - starts)[first]
        self.words.append(data[gather_ranges(starts[first], size)])
        self.sizes.append(size)
        self.chunks.append((ids, rows, (codes + self.count).astype(np.int32), weight))
        self.count += len(first)
        self.bytes += len(data)

    def close(self, buckets: int):
        """The number of each chunk's distinct words in the order by bucket; in that order buckets, word sizes and all words' bytes; a sum over the words."""
        data = np.concatenate(self.words) if self.words else np.zeros(0, np.uint8)
        size = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        starts = np.cumsum(size) - size
        codes, first, hashes = textscan.distinct(data, starts, starts + size)
        bucket = ((hashes >> np.uint64(17)) % np.uint64(buckets)).astype(np.int32)
        # within a bucket by hash: the order then depends on the words alone (on their first places, where words share a hash)
        order = np.lexsort((hashes, bucket))
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        guard = int(np.bitwise_xor.reduce(textscan.mix(hashes)).astype(np.int64)) if len(hashes) else 0
        first = first[order]
        return number[codes], bucket[order], size[first], data[gather_ranges(starts[first], size[first])], guard


def blocks(batches: Iterator[pa.RecordBatch], scan: Scan, weigh: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, _Block]]:
    """Blocks of a task's documents, with a number that is unique in the job."""
    made, block = TaskContext.get().partitionId() << 32, _Block()
    for batch in batches:
        data, offs = textscan.buffer_of(batch.column(1))
        ids = batch.column(0)
        for lo, hi in textscan.row_chunks(offs):
            part = ids.slice(lo, hi - lo)
            block.add(part, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], scan, weigh(part) if weigh else None)
            if block.bytes >= BLOCK_BYTES:
                yield made, block
                made, block = made + 1, _Block()
    if block.chunks:
        yield made, block


def word_rows(docs: DataFrame, scan: Scan, buckets: int, weigh: Callable | None = None) -> DataFrame:
    """A row for each block and bucket: the block's distinct words of the bucket and how often each occurs.

    docs: doc_id, text.  weigh: gets ids of documents and tells which of them count (all, if None).
    """

    def run(batches):
        for made, block in blocks(batches, scan, weigh):
            number, inside, sizes, words, guard = block.close(buckets)
            counts = np.zeros(len(inside), np.int64)
            for _, rows, own, weight in block.chunks:
                each = None if weight is None else np.repeat(weight, np.diff(rows))
                counts += np.bincount(number[own], each, len(inside)).astype(np.int64)
            edges = np.flatnonzero(np.diff(inside, prepend=-1, append=-1))
            places = np.concatenate([[0], np.cumsum(sizes)])
            out: list[tuple] = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                size, packed = pack(sizes[lo:hi].astype(np.uint32), words[places[lo] : places[hi]])
                out.append((int(inside[lo]), made, guard, hi - lo, size, packed, pack(counts[lo:hi])[1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "block", "guard", "n", "size", "words", "counted"])

    return docs.mapInArrow(run, WORDS_SCHEMA)


def span_rows(docs: DataFrame, scan: Scan, buckets: int) -> DataFrame:
    """A row for each chunk of a block: its documents and the numbers of their words in the block's order."""

    def run(batches):
        for made, block in blocks(batches, scan):
            number, *_, guard = block.close(buckets)
            for k, (ids, rows, own, _) in enumerate(block.chunks):
                size, packed = pack(number[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([made], pa.int64()), pa.array([k], pa.int32()), pa.array([guard], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([np.diff(rows).astype(np.uint32).tobytes()], pa.binary()), pa.array([size], pa.int32()), pa.array([packed], pa.binary())],
                    names=["block", "part", "guard", "doc_ids", "lengths", "size", "numbers"],
                )

    return docs.mapInArrow(run, SPANS_SCHEMA)


def word_bytes(n: int, size: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of a row's words, and their bytes one word behind another."""
    raw = unpack(size, packed)
    return np.frombuffer(raw, np.uint32, n), np.frombuffer(raw, np.uint8, -1, 4 * n)


def words_of(n: int, size: int, packed: bytes) -> list[bytes]:
    raw = unpack(size, packed)
    ends = 4 * n + np.cumsum(np.frombuffer(raw, np.uint32, n), dtype=np.int64)
    return [raw[s:e] for s, e in zip(np.concatenate([[4 * n], ends[:-1]]).tolist(), ends.tolist())]


def by_bucket(rows: DataFrame, n: int) -> DataFrame:
    """The rows of a bucket together, one bucket after another."""
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket")


def meet(spans: DataFrame, answers: DataFrame, tasks: int, finish: Callable, schema: str) -> DataFrame:
    """finish(doc_ids, lengths, numbers, answer rows by bucket) for each chunk, where its block's answers have arrived.

    answers: block, bucket, guard and any more columns.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        guards = {*left.column("guard").to_pylist(), *right.column("guard").to_pylist()}
        if len(guards) > 1:
            raise RuntimeError("the documents changed between two reads; write them to a table first")
        prepared = finish(right)
        out = []
        for row in left.select(["doc_ids", "lengths", "size", "numbers"]).to_batches():
            for k in range(row.num_rows):
                ids = row.column(0)[k].values
                numbers = np.frombuffer(unpack(row.column(2)[k].as_py(), row.column(3)[k].as_py()), np.uint32)
                out.append(prepared(ids, np.frombuffer(row.column(1)[k].as_py(), np.uint32).astype(np.int64), numbers))
        textscan.release()
        return pa.concat_tables(out) if out else prepared(pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    left, right = (side.repartition(tasks, "block") for side in (spans, answers))
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, schema)
