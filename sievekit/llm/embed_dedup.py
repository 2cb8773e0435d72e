"""Embedding near-dedup by randomised-rotation binary codes (RaBitQ; Gao and Long, 2024)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import save, small_batches
from sievekit.llm.components import connected
from sievekit.llm.vectors import blocked, matrix, usable

#: Vectors of a block; two blocks are compared by one task.
BLOCK = 2048
_SLAB = 256
#: Standard deviations to which bounds are trusted: a link at the threshold itself is missed with a chance near 1e-9, others less.
SIGMAS = 6.0


def rotation(dimensions: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for one seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


class Codes:
    """Codes of unit vectors: the signs after the rotation, as a unit vector x of +-1/sqrt(D), and <o, x> of each vector o."""

    def __init__(self, units: np.ndarray, turn: np.ndarray):
        self.turned = units @ turn.T
        d = units.shape[1]
        self.packed = np.packbits(self.turned > 0, axis=1)
        self.factor = np.abs(self.turned).sum(axis=1) / np.sqrt(d)

    @staticmethod
    def signs(packed: np.ndarray, d: int) -> np.ndarray:
        return (np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))


def estimate(raw: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Unbiased estimates of <q, o> from raw = <q, x>, x the code of o and factor = <o, x>.

    <q, x> is <q, o> <o, x> and what the parts of q and x beside o have in common, which over random rotations points anywhere.
    """
    return raw / factor


def slack(factor: np.ndarray, dimensions: int, threshold: float, sigmas: float = SIGMAS) -> np.ndarray:
    """How far the estimate of a product of `threshold` or more may fall below it: `sigmas` standard deviations of the estimate.

    The error is sqrt(1 - <q, o>**2) times a coordinate of a random direction in the dimensions beside o, times the
    tangent of the angle between o and its code.
    """
    return sigmas * np.sqrt(max(1 - threshold**2, 0) * (1 - np.minimum(factor, 1) ** 2) / max(dimensions - 1, 1)) / factor


def most_differing(dimensions: int, threshold: float, sigmas: float = SIGMAS) -> int:
    """How many bits may differ between codes of vectors with a product of `threshold` or more.

    A bit differs with the chance angle / pi; the bits of one rotation vary less than independent ones.
    """
    p = np.arccos(np.clip(threshold, -1, 1)) / np.pi
    return int(min(np.ceil(dimensions * p + sigmas * np.sqrt(dimensions * p * (1 - p))), dimensions))


def _words(packed: np.ndarray) -> np.ndarray:
    """Codes in words of 64 bits, a column for each."""
    wide = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return np.ascontiguousarray(wide.view(np.uint64).T)


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels of nodes, joined along the edges: the smallest node of each component."""
    while len(u):
        a, b = label[u], label[v]
        low = np.minimum(a, b)
        if (a == b).all():
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            after = label[label]
            if (after == label).all():
                break
            label = after
    return label


def _compare(a: dict, b: dict, same: bool, threshold: float, seen: list | None = None):
    """Copies linked with each vector of a and of b, and links that connect them; a and b are one block if same.

    Codes are compared as bits; the unbiased estimate with its confidence bound then decides which of the pairs that are near
    in bits are computed exactly.  seen: gets how many pairs there were, how many were near in bits, and how many were computed.
    """
    d = a["vectors"].shape[1]
    turned = Codes(a["units"], rotation(d)).turned.astype(np.float32)
    signs = Codes.signs(b["codes"], d)
    wa, wb = _words(a["codes"]), _words(b["codes"])
    most = most_differing(d, threshold)
    least = (threshold - slack(b["factor"], d, threshold) - 1e-6).astype(np.float32)
    factor = b["factor"].astype(np.float32)
    na, nb = len(turned), len(signs)
    ca, cb = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    label = np.arange(na + (0 if same else nb))
    shift = 0 if same else na
    for lo in range(0, na, _SLAB):
        hi = min(lo + _SLAB, na)
        differing = np.bitwise_count(wa[0, lo:hi, None] ^ wb[0][None, :]).astype(np.uint16)
        for x, y in zip(wa[1:], wb[1:]):
            differing += np.bitwise_count(x[lo:hi, None] ^ y[None, :])
        near = differing <= most
        if same:  # each pair once
            near &= np.arange(nb)[None, :] > np.arange(lo, hi)[:, None]
        i, j = np.nonzero(near)
        bits = len(i)
        for_all = len(i) > near.size // 8
        if for_all:
            raw = (turned[lo:hi] @ signs.T)[i, j]
        else:
            raw = np.empty(len(i), np.float32)
            for at in range(0, len(i), 1 << 14):
                part = slice(at, at + (1 << 14))
                raw[part] = np.einsum("ij,ij->i", turned[i[part] + lo], signs[j[part]])
        kept = estimate(raw, factor[j]) >= least[j]
        i, j = i[kept], j[kept]
        if seen is not None:
            seen.append((near.size if not same else sum(nb - 1 - r for r in range(lo, hi)), bits, len(i)))
        if not len(i):
            continue
        if len(i) > near.size // 10:
            cosine = ((a["vectors"][lo:hi] @ b["vectors"].T) / a["norm"][lo:hi][:, None] / b["norm"][None, :])[i, j]
        else:
            cosine = np.empty(len(i))
            for at in range(0, len(i), 1 << 14):
                x, y = i[at : at + (1 << 14)] + lo, j[at : at + (1 << 14)]
                cosine[at : at + len(x)] = np.einsum("ij,ij->i", a["vectors"][x], b["vectors"][y]) / (a["norm"][x] * b["norm"][y])
        linked = cosine >= threshold
        i, j = i[linked] + lo, j[linked]
        np.add.at(ca, i, b["copies"][j])
        np.add.at(ca if same else cb, j, a["copies"][i])
        label = _merge(label, i, j + shift)
    return ca, cb, label


def link_vectors(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: vectors of one label linked at a cosine of `threshold` or more.

    Equal vectors of a label collapse to one that carries their number.  The others are packed into blocks of fixed
    size with their codes and factors, and each pair of blocks of a label is compared by one task: the unbiased estimate with its
    confidence bound (SIGMAS) drops a pair or sends it to exact recomputation in double precision.
    A task returns sums for each vector and a spanning forest of its links, never the pairs.
    One row comes out for each row that goes in.  Vectors that are null, empty, zero or hold null or non-finite
    components, and rows with a null label or a null id, link with nothing (their component_id is their id).  Vectors of different lengths don't
    link.  Repeated rows count as vectors of their own.  Other columns are ignored; an empty table gives an empty table.
    """
    spark = rows.sparkSession
    small_batches(spark)
    every = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("long").alias("label"))
    fit = usable(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    every = every.withColumn("fit", F.coalesce(fit, F.lit(False)))
    good = every.filter("fit").select("vec_id", "v", "label")
    distinct = good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("d", F.size("v"))

    def pack_block(key: tuple, group: pa.Table) -> pa.Table:
        vectors = matrix(group.column("v"))
        # by powers of two, which changes no cosine, so that squares stay within range
        vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        codes = Codes(vectors / norm[:, None], rotation(vectors.shape[1]))
        parts = [group.column("rep").to_numpy(), group.column("copies").to_numpy(), vectors, codes.packed, codes.factor]
        row = {"label": key[0], "d": key[1], "block": key[2], "blocks": group.column("blocks")[0], "n": pa.scalar(len(vectors), pa.int32()), "packed": pa.scalar(b"".join(np.ascontiguousarray(p).tobytes() for p in parts), pa.binary())}
        return pa.table({k: pa.array([v.as_py()], v.type) for k, v in row.items()})

    dealt = blocked(distinct, ["label", "d"], "rep", block)
    packs = dealt.groupBy("label", "d", "block").applyInArrow(pack_block, "label long, d int, block int, blocks int, n int, packed binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = packs.select("*", other).select("label", "d", "block", "n", "packed", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def opened(n: int, d: int, packed: bytes) -> dict:
        at, out = 0, {}
        for name, kind, shape in (("rep", np.int64, (n,)), ("copies", np.int64, (n,)), ("vectors", np.float64, (n, d)), ("codes", np.uint8, (n, -(-d // 8))), ("factor", np.float64, (n,))):
            size = int(np.prod(shape)) * np.dtype(kind).itemsize
            out[name] = np.frombuffer(packed, np.uint8)[at : at + size].copy().view(kind).reshape(shape)
            at += size
        out["norm"] = np.sqrt((out["vectors"] ** 2).sum(axis=1))
        out["units"] = out["vectors"] / out["norm"][:, None]
        return out

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        sides = [opened(n, key[1].as_py(), p) for n, p in zip(group.column("n").to_pylist(), group.column("packed").to_pylist())]
        a, b = sides[0], sides[-1]
        reps = a["rep"] if len(sides) == 1 else np.concatenate([a["rep"], b["rep"]])
        if len(sides) == 1 and key[2].as_py() != key[3].as_py():  # an empty block is not packed, its cells have one side
            return pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        ca, cb, label = _compare(a, b, len(sides) == 1, threshold)
        links = ca if len(sides) == 1 else np.concatenate([ca, cb])
        some = np.flatnonzero(links)
        return pa.table({"rep": pa.array(reps[some]), "links": pa.array(links[some]), "root": pa.array(reps[label[some]])})

    found = save(cells.groupBy("label", "d", "i", "j").applyInArrow(compare, "rep long, links long, root long"), "vector-links")
    component = connected(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = distinct.join(sums, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = every.filter("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
