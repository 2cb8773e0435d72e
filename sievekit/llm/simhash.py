"""SimHash near-dedup by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm import textscan
from sievekit.llm.common import partitions, save, texts
from sievekit.llm.components import connected

SEED = 42
BITS, SEGMENT = 64, 32


def fingerprints_of(data: np.ndarray, offs: np.ndarray, width: int = 3) -> np.ndarray:
    """A fingerprint for each row, as uint64."""
    from xxhash import xxh64_intdigest

    data = textscan.lower_ascii(data)
    starts, ends, rows = textscan.words(data, offs)
    out = np.zeros(len(offs) - 1, np.uint64)
    if not len(starts):
        return out
    raw, starts, ends = textscan.joined(data, starts, ends)
    counts = np.diff(rows)
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.repeat(rows[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(int(shingles.sum()))
    last = np.minimum(first + width, np.repeat(rows[1:], shingles)) - 1
    hashes = np.fromiter((xxh64_intdigest(raw[s:e], SEED) for s, e in zip(starts[first].tolist(), ends[last].tolist())), np.uint64, len(first))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.flatnonzero(shingles)
    at = (np.cumsum(shingles) - shingles)[full]
    ones = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * ones > shingles[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def text_digest(text_col: str = "text") -> Column:
    """A number by which the texts of one id are told apart."""
    return F.xxhash64(text_col)


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, fp: 64 bits, each 1 if it is set in over half the hashes of the text's shingles (repeats included); with `digest` the text's digest too."""
    names = ["doc_id", "fp", *["digest"] * digest]
    plain = texts(docs, id_col, text_col)
    if digest:
        plain = plain.withColumn("digest", text_digest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textscan.buffer_of(batch.column(1))
            for lo, hi in textscan.row_chunks(offs):
                fp = fingerprints_of(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], width)
                own = [batch.column(k).slice(lo, hi - lo) for k in (0, *[2] * digest)]
                yield pa.RecordBatch.from_arrays([own[0], pa.array(fp.view(np.int64)), *own[1:]], names=names)

    return plain.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _primary(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the bucket is the one that reports the pair: of the buckets in which both stand, one is fixed."""
    half = np.uint64(0xFFFFFFFF)
    x0, y0, x1, y1 = x & half, y & half, x >> np.uint64(SEGMENT), y >> np.uint64(SEGMENT)
    own = np.where(np.bitwise_count(x0 ^ y0) <= 1, np.minimum(x0, y0), np.minimum(x1, y1) | np.uint64(1 << SEGMENT))
    return own == key


def _forest(members: np.ndarray, key: np.uint64, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected in a large bucket: fewer than members."""
    left = np.arange(len(members))
    out = []
    while len(left):
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            near = np.empty(0, np.int64)
            for lo in range(0, len(reached), 256):
                some = members[reached[lo : lo + 256]]
                for at in range(0, len(left), 4096):
                    other = members[left[at : at + 4096]]
                    fits = np.bitwise_count(some[:, None] ^ other[None, :]) <= radius
                    fits &= _primary(key, some[:, None], other[None, :])
                    hit = np.flatnonzero(fits.any(axis=0))
                    if len(hit):
                        out.append((some[fits[:, hit].argmax(axis=0)], other[hit]))
                        near = np.concatenate([near, left[at + hit]])
                left = np.setdiff1d(left, near, assume_unique=True)
            reached = near
    return out


#: Members of a bucket up to which all its pairs are compared at once over all buckets of a batch.
_SMALL = 24


def _links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of sorted keys."""
    edges = np.concatenate([np.flatnonzero(np.diff(keys, prepend=~keys[:1])), [len(keys)]])
    size = np.diff(edges)
    u, v = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    small = np.repeat((size > 1) & (size <= _SMALL), size)
    k, f = keys[small], fps[small]
    for step in range(1, min(_SMALL, len(k))):
        same = np.flatnonzero(k[step:] == k[:-step])
        if not len(same):
            break
        x, y = f[same], f[same + step]
        fits = np.bitwise_count(x ^ y) <= radius
        x, y, own = x[fits], y[fits], k[same][fits]
        fits = _primary(own, x, y)
        u.append(x[fits])
        v.append(y[fits])
    for i in np.flatnonzero(size > _SMALL).tolist():
        for x, y in _forest(np.unique(fps[edges[i] : edges[i + 1]]), keys[edges[i]], radius):
            u.append(x)
            v.append(y)
    return np.concatenate(u), np.concatenate(v)


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """u, v: links that connect all distinct fingerprints `fp` at `radius` or fewer differing bits.

    A fingerprint has two segments of 32 bits.  Of two fingerprints with three differing bits or fewer, one segment
    has one differing bit at most, so both stand in a bucket if each goes to the buckets of its segments and
    of all segments in the Hamming ball of radius one around them.  Whatever meets in a bucket is compared
    in full.  Each linked pair is reported by one bucket alone, and a large bucket reports a spanning forest of its
    pairs, not all.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of radius one find up to 3 differing bits")
    flips = F.array(*[F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(SEGMENT)]])
    low, high = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1)), F.shiftrightunsigned("fp", SEGMENT)
    probes = distinct.select("fp", F.explode(flips).alias("flip")).select("fp", F.explode(F.array(low.bitwiseXOR(F.col("flip")), high.bitwiseXOR(F.col("flip")).bitwiseOR(F.lit(1 << SEGMENT)))).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(keys, fps):
            u, v = _links(keys, fps, radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            k, f = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (1, 0))
            if not len(k):
                continue
            held.append((k, f))
            if k[0] == k[-1] and sum(len(x) for x, _ in held) < 1 << 22 or sum(len(x) for x, _ in held) < 1 << 16:
                continue
            keys, fps = (np.concatenate(c) for c in zip(*held))
            whole = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            if whole:
                yield done(keys[:whole], fps[:whole])
            held = [(keys[whole:], fps[whole:])]
        if held:
            yield done(*(np.concatenate(c) for c in zip(*held)))

    dealt = probes.repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, fp, component_id, and with `digest` the text's digest: near-duplicates by SimHash; component_id is the smallest id reachable by links.

    Words are lower-cased in A-Z.  Copies collapse to their fingerprint first, and only distinct fingerprints are
    compared.  One row comes out for each row that goes in: repeated rows are in one component, rows with a null id
    have a component_id if some linked row has an id; a text without words, null included, has fingerprint
    zero and links like any other; other columns are ignored; an empty table gives an empty table; texts are read whole, whatever their length.
    """
    found = save(fingerprints(docs, width, id_col, text_col, digest), "fingerprints")
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected(links(distinct, radius))
    labelled = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    # one row for a fingerprint, so a large component is summed before the shuffle and its rows go back by a join
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return found.join(labelled.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id", *["digest"] * digest)


def digests(documents: DataFrame) -> DataFrame:
    out = near_duplicates(documents)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
