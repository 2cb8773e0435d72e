"""Exact top-k inner products by norm-bucketed retrieval (LEMP; Teflioudi et al., 2015)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm.common import forget, gather_ranges, save, small_batches
from sievekit.llm.vectors import matrix, usable

#: Candidates and queries that one task compares.
CANDIDATES, QUERIES = 8192, 2048
#: Vectors of a norm bucket.
BUCKET = 512
#: What one product costs where it stands alone, in products of a matrix.
ALONE = 12

_PACK = "d int, g long, n int, longest double, packed binary"
_FOUND = "q long, place int, query_id long, vec_id long, score long, length double"


class Best:
    """The k best scores of each query so far, ties to the smaller id; no score below a query's floor counts."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.floor = np.full(queries, -np.inf) if floor is None else floor
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    @property
    def least(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Any number of results for each of some queries."""
        touched = np.unique(query)
        row = np.concatenate([np.repeat(touched, self.k), query])
        all_scores, all_ids = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((all_ids, -all_scores, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < self.k
        self.score[touched] = all_scores[order][kept].reshape(-1, self.k)
        self.id[touched] = all_ids[order][kept].reshape(-1, self.k)


def _windows(queries: np.ndarray, qnorm: np.ndarray, focus: np.ndarray, local: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the range, among a bucket's directions in the order of its largest coordinate, that its local threshold leaves.

    sides: the directions' coordinates, each column sorted.  A cosine of t or more puts both angles to the coordinate's axis
    within arccos(t) of each other.
    """
    own = np.arccos(np.clip(queries[np.arange(len(queries)), focus] / qnorm, -1, 1))
    reach = np.arccos(np.clip(local, -1, 1))
    low, high = np.cos(np.minimum(own + reach, np.pi)) - 1e-9, np.cos(np.maximum(own - reach, 0)) + 1e-9
    first, last = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
    for f in np.unique(focus).tolist():
        some = focus == f
        first[some], last[some] = np.searchsorted(sides[:, f], low[some]), np.searchsorted(sides[:, f], high[some], "right")
    return first, last


def search(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None, seen: list | None = None) -> Best:
    """The k largest inner products of each query with the vectors of other ids, of those that reach its floor.

    Vectors go through by length, longest first.  A bucket's local threshold for a query is the cosine that its
    longest vector needs to reach the query's k-th best score or its floor.  Above 1 the bucket is pruned whole; else either
    shorter vectors of the bucket are pruned by length, or the query's largest coordinate says in which range a vector's same
    coordinate must be: whichever leaves less work.  What is left is verified by products.  All numbers are integers below 2**53, so exact.
    seen: gets how many products were computed, by length and by coordinate.
    """
    best = Best(len(qids), k, floor)
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    order = np.lexsort((ids, -norm))
    ids, vectors, norm = ids[order], vectors[order], norm[order]
    qnorm = np.sqrt((queries * queries).sum(axis=1))
    focus = np.abs(queries).argmax(axis=1) if queries.shape[1] else np.zeros(len(queries), np.int64)
    for lo in range(0, len(ids), BUCKET):
        part, length, own = vectors[lo : lo + BUCKET], norm[lo : lo + BUCKET], ids[lo : lo + BUCKET]
        floor_now = best.least
        active = (floor_now <= qnorm * length[0] * (1 + 1e-9)) | ~np.isfinite(floor_now)
        with np.errstate(invalid="ignore", divide="ignore"):
            # a query of length zero has the product 0 with all, as is any score it could miss
            needed = np.where((floor_now > 0) & (qnorm > 0), floor_now / qnorm, 0)
        long = np.searchsorted(-length, -needed * (1 - 1e-9), "right")
        sharp = np.zeros(len(qids), bool)
        asks = np.flatnonzero(active & (needed > 0))
        if len(asks):
            unit = part / np.where(length > 0, length, 1)[:, None]
            by_side = np.argsort(unit, axis=0, kind="stable")
            first, last = _windows(queries[asks], qnorm[asks], focus[asks], needed[asks] / length[0], np.take_along_axis(unit, by_side, axis=0))
            cheaper = ALONE * (last - first) < long[asks]
            sharp[asks[cheaper]] = True
            first, count, asks = first[cheaper], (last - first)[cheaper], asks[cheaper]
        # by length: queries together, over the vectors that are long enough for one of them at least
        some = np.flatnonzero(active & ~sharp)
        some = some[np.argsort(long[some], kind="stable")]
        for at in range(0, len(some), 256):
            q = some[at : at + 256]
            n = int(long[q].max())
            scores = queries[q] @ part[:n].T
            if seen is not None:
                seen.append((scores.size, 0))
            scores = np.where(own[None, :n] == qids[q][:, None], -np.inf, scores)
            least = floor_now[q]
            if n > k:
                least = np.maximum(least, np.partition(scores, n - k, axis=1)[:, n - k])
            i, j = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
            if len(i):
                best.add(q[i], own[j], scores[i, j])
        if sharp.any():
            step = max(1, (1 << 15) // BUCKET)
            for at in range(0, len(asks), step):
                rows = slice(at, at + step)
                place = gather_ranges(first[rows], count[rows])
                q = np.repeat(asks[rows], count[rows])
                j = by_side[place, focus[q]]
                scores = np.einsum("ij,ij->i", part[j], queries[q])
                if seen is not None:
                    seen.append((0, len(j)))
                kept = (scores >= floor_now[q]) & (own[j] != qids[q])
                if kept.any():
                    best.add(q[kept], own[j[kept]], scores[kept])
    return best


def _packs(rows: DataFrame, size: int, scale: int, parts: int, by_length: bool) -> DataFrame:
    """Vectors of one length in packs of at most `size`, longest first if by_length; g says their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def pack(some: list[pa.RecordBatch]):
            nonlocal g
            ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in some]).astype(np.int64)
            vectors = np.floor(np.concatenate([matrix(b.column(1)) for b in some]) * scale)
            g += 1
            with np.errstate(over="ignore"):
                longest = float(np.sqrt((vectors * vectors).sum(axis=1)).max())
            return pa.RecordBatch.from_arrays([pa.array([vectors.shape[1]], pa.int32()), pa.array([g], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([longest]), pa.array([ids.tobytes() + vectors.tobytes()], pa.binary())], names=["d", "g", "n", "longest", "packed"])

        for batch in batches:
            d = batch.column(2).to_numpy()
            edges = np.flatnonzero(np.diff(d, prepend=-1, append=-1)).tolist()
            for lo, hi in zip(edges[:-1], edges[1:]):
                if held and held[0].column(2)[0].as_py() != d[lo]:
                    yield pack(held)
                    held = []
                while lo < hi:
                    some = min(hi - lo, size - sum(b.num_rows for b in held))
                    held.append(batch.slice(lo, some))
                    lo += some
                    if sum(b.num_rows for b in held) == size:
                        yield pack(held)
                        held = []
        if held:
            yield pack(held)

    order = ["d", F.desc("squares"), F.xxhash64("vec_id")] if by_length else ["d", F.xxhash64("vec_id")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "vec_id")
    return dealt.select("vec_id", "v", "d").mapInArrow(run, _PACK)


def top_products(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of floor(scale * x) of each query with all other rows.

    Candidates are cut by length, over the whole table, into groups, and queries into packs, both of fixed size.  The longest group meets all
    queries first, then two groups, four, and so on: each round starts from the k-th best scores of the rounds before, a
    group whose longest vector can't reach the least of a pack's isn't sent to it, and in a task the threshold rises further from
    bucket to bucket.  What a round leaves behind is k rows for each query.
    Vectors that are null or hold null or non-finite components, and rows with a null id,
    take no part; vectors of different lengths don't meet; an empty vector meets none.  A query never
    meets rows of its own id; other rows count each, repeated or not.  A repeated query row asks again: it has its own k rows, with
    ranks from 1.  Ties go to the smaller id.  Other columns are ignored; an
    empty table gives an empty table.  Products that need 2**53 or more are computed with whole numbers of any
    size, and a score beyond 64 bits becomes the nearest that fits.
    """
    spark = rows.sparkSession
    small_batches(spark)
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    good = good.filter(usable(F.col("v")) & F.col("vec_id").isNotNull()).withColumn("d", F.size("v"))
    good = good.withColumn("squares", F.aggregate("v", F.lit(0.0), lambda s, x: s + (x * scale) * (x * scale)))
    total, asking = good.agg(F.count("*"), F.count_if("asks")).first()
    groups = save(_packs(good, candidates, scale, max(1, -(-total // candidates)), True), "norm-groups")
    asked = save(_packs(good.filter("asks"), queries, scale, max(1, -(-asking // queries)), False), "query-packs").withColumnRenamed("g", "q").drop("longest")

    def compare(key: tuple, cell: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], t) for c, t in (("q", pa.int64()), ("place", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("length", pa.float64()))})
        if len(cell) < 2:
            return empty
        cell, d, sides = cell.sort_by("side"), key[0].as_py(), []
        for n, packed in zip(cell.column("n").to_pylist(), cell.column("packed").to_pylist()):
            sides.append((np.frombuffer(packed, np.int64, n), np.frombuffer(packed, np.float64, n * d, 8 * n).reshape(n, d)))
        (ids, vectors), (qids, asks) = sides
        floors = np.full(len(qids), -np.inf)
        for known in cell.column("floors").to_pylist()[1] or []:
            floors[known["place"]] = known["least"]
        length = np.sqrt((asks * asks).sum(axis=1))
        if d * float(np.abs(vectors).max(initial=0)) * float(np.abs(asks).max(initial=0)) < 2.0**53:
            best = search(qids, asks, ids, vectors, k, floors)
            i, j = np.nonzero(np.isfinite(best.score))
            return pa.table({"q": pa.array(np.full(len(i), key[2].as_py())), "place": pa.array(i.astype(np.int32)), "query_id": pa.array(qids[i]), "vec_id": pa.array(best.id[i, j]), "score": pa.array(best.score[i, j].astype(np.int64)), "length": pa.array(length[i])})
        whole = [[int(x) for x in row] for row in vectors.tolist()]
        out = []
        for p, (q, row) in enumerate(zip(qids.tolist(), asks.tolist())):
            row = [int(x) for x in row]
            scored = sorted((-sum(a * b for a, b in zip(row, other)), i) for i, other in zip(ids.tolist(), whole) if i != q)[:k]
            out += [(key[2].as_py(), p, q, i, max(min(-s, 2**63 - 1), -(2**63)), length[p]) for s, i in scored]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), empty.schema.types)], names=empty.schema.names) if out else empty

    # a row for each group: how many there are of longer vectors
    heads = save(groups.select("d", "g", "longest").withColumn("turn", F.row_number().over(Window.partitionBy("d").orderBy("g"))), "group-heads")
    last = heads.agg(F.max("turn")).first()[0] or 0
    rank = F.row_number().over(Window.partitionBy("q", "place").orderBy(F.desc("score"), "vec_id"))
    best, begin = spark.createDataFrame([], _FOUND), 1
    while begin <= last:
        turn = heads.filter((F.col("turn") >= begin) & (F.col("turn") < 2 * begin))
        floors = best.groupBy("q", "place").agg(F.min("score").alias("least"), F.count("*").alias("n"), F.min("length").alias("length")).filter(F.col("n") == k)
        # the length that a vector needs to be of use for any query of the pack; none where a query isn't full yet
        needs = F.min(F.when(F.col("length") > 0, F.col("least") / F.col("length")).otherwise(F.lit(float("-inf"))))
        floors = floors.groupBy("q").agg(F.collect_list(F.struct("place", F.col("least").cast("double").alias("least"))).alias("floors"), F.count("*").alias("full"), needs.alias("needs"))
        asks = asked.join(floors, "q", "left")
        reach = F.when(F.col("full") == F.col("n"), F.col("needs")).otherwise(F.lit(float("-inf")))
        pairs = turn.join(asks.select("d", "q", reach.alias("reach")), "d").filter(F.col("longest") * (1 + 1e-9) >= F.col("reach")).select("d", "g", "q")
        left = groups.join(pairs, ["d", "g"]).select("d", "g", "q", F.lit(0).alias("side"), "n", "packed", F.lit(None).cast("array<struct<place:int,least:double>>").alias("floors"))
        right = asks.join(pairs, ["d", "q"]).select("d", "g", "q", F.lit(1).alias("side"), "n", "packed", "floors")
        found = left.union(right).groupBy("d", "g", "q").applyInArrow(compare, _FOUND)
        now = save(best.union(found).withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"), "best")
        forget(best)
        best, begin = now, 2 * begin
    forget(groups)
    forget(asked)
    return best.withColumn("rank", rank).select("query_id", "rank", "vec_id", "score")
