"""Multidimensional clustered layout: rows along a space-filling curve, files of it, and which files a query box meets.

A dimension's coordinate is the rank of its value among all rows, in `side` equal steps; so at most side - 1 values of a dimension
begin a step, and only these come to the driver.  Rows are numbered along the curve by ranges (operators.ordinals).  A file is a run of the curve, and
is asked about through its corner point: the lower and the upper bound in each dimension.  Boxes and cells of one value of the
dimensions that a query fixes meet in one group; there a KD-tree over the corner points counts the files whose bounds meet a query
(dominance: no lower bound over the query's upper one, no upper bound under its lower one), and a KD-tree over cells lists
the runs of files that hold rows inside it.

The number of cells is side ** dimensions at most, and files with equal bounds are one point with a weight, so a group doesn't grow beyond that
however many rows there are.  Files are joined and counted in shuffles; none of their tables is broadcast or collected.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import save
from sievekit.llm.kdtree import Tree
from sievekit.operators import ordinals

#: Files whose rows of one cell meet in a task at once.
_FILES = 1000


def sort_key(value: Column, kind: str) -> Column:
    """Bytes in the order of the values, null first: strings by their UTF-8 bytes, numbers of 0 or more by their digits."""
    text = value.cast("string") if kind == "string" else F.lpad(value.cast("string"), 20, "0")
    return F.when(value.isNull(), F.lit(b"\x00")).otherwise(F.concat(F.lit(b"\x01"), F.encode(text, "UTF-8")))


def steps(rows: DataFrame, dimensions: list[str], side: int) -> list[list[bytes]]:
    """For each dimension (a column of bytes) the smallest value of each coordinate from 1 on that any value has or passes.

    Counts of distinct values are summed along the order of the values; a coordinate is floor(side * rows with a smaller value / rows).
    """
    n = rows.count()
    each = rows.groupingSets([[F.col(d)] for d in dimensions], *dimensions).agg(F.grouping_id().alias("__set"), F.count("*").alias("__n"))
    which = {((1 << len(dimensions)) - 1) ^ (1 << (len(dimensions) - 1 - k)): k for k in range(len(dimensions))}
    column = F.element_at(F.create_map(*(F.lit(x) for pair in which.items() for x in pair)), F.col("__set").cast("int"))
    value = reduce(lambda a, k: F.when(F.col("__set") == k, F.col(dimensions[which[k]])).otherwise(a), which, F.lit(None).cast("binary"))
    values = each.select(column.alias("__dim"), value.alias("__value"), "__n")
    summed = ordinals.running_sum(values, ["__dim", "__value"], "__n", "__smaller")
    step = F.expr(f"({side} * (__smaller - __dim * {n}L)) div {max(n, 1)}L")
    found = summed.groupBy("__dim", step.cast("int").alias("__step")).agg(F.min("__value").alias("__value")).collect()  # side rows a dimension at most
    return [[bytes(r["__value"]) for r in sorted(found, key=lambda r: r["__step"]) if r["__dim"] == k for _ in range(r["__step"] - max([s["__step"] for s in found if s["__dim"] == k and s["__step"] < r["__step"]], default=0))] for k in range(len(dimensions))]


def interleave(coordinates: list[Column], bits: int) -> Column:
    """The binary digits of the coordinates in turns, highest first, the first coordinate's first."""
    z = F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for c in coordinates:
            z = F.shiftleft(z, 1).bitwiseOR(F.shiftright(c, bit).bitwiseAND(F.lit(1)))
    return z


def coordinate(z: Column, k: int, dimensions: int, bits: int) -> Column:
    """The k-th coordinate of a place on the curve."""
    out = F.lit(0)
    for bit in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(z, bit * dimensions + dimensions - 1 - k).bitwiseAND(F.lit(1)).cast("int"), bit))
    return out


def _meet(dimensions: int, bits: int, radius: list[int]):
    """For the boxes and the cells of one group: how many files each cell's query touches, and how many match."""

    def run(boxes: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        z = cells["z"].to_numpy()
        at = np.stack([sum(((z >> (bit * dimensions + dimensions - 1 - k)) & 1) << bit for bit in range(bits)) for k in range(dimensions)], axis=1) if len(z) else np.zeros((0, dimensions), np.int64)
        low, high = at - np.array(radius), at + np.array(radius)
        corners = boxes[[*(f"lo{k}" for k in range(dimensions)), *(f"hi{k}" for k in range(dimensions))]].to_numpy(np.int64)
        least, most = np.full_like(low, -1), np.full_like(high, 1 << bits)
        touched = Tree(corners, boxes["files"].to_numpy(np.int64)).count(np.hstack([least, low]), np.hstack([high, most]))
        query, cell = Tree(at, np.ones(len(at), np.int64)).inside(low, high)
        order = np.lexsort((z[cell], query))
        query, first, last = query[order], cells["first"].to_numpy(np.int64)[cell[order]], cells["last"].to_numpy(np.int64)[cell[order]]
        again = np.zeros(len(query), np.int64)  # along the curve a run of files can begin in the file in which the one before ended
        again[1:] = (query[1:] == query[:-1]) & (first[1:] == last[:-1])
        matching = np.bincount(query, last - first + 1 - again, len(z)).astype(np.int64)
        return pd.DataFrame({"z": z, "first": cells["first"], "last": cells["last"], "touched": touched, "matching": matching})

    return run


def clustered(rows: DataFrame, key: str, dimensions: list[tuple[str, str]], radius: list[int], rows_per_file: int = 1000, side: int = 16) -> DataFrame:
    """key, z, position, file, files_touched, files_matching, lo0.., hi0..: the layout of all rows, and what each row's query meets.

    dimensions: columns and their kinds ("string", or "number" of 0 or more); null is the smallest value.  radius: how far from the row's own coordinate its
    query reaches in each; at least one must be 0, as groups are by these.  side: a power of two.
    Every row has a position: repeated rows and null keys too (ties in any order); an empty table gives an empty one; other columns
    are ignored; of values only their order counts, so their length doesn't matter.
    """
    k, bits = len(dimensions), side.bit_length() - 1
    narrow = save(rows.select(F.col(key).cast("long").alias("key"), *(sort_key(F.col(c), kind).alias(f"v{i}") for i, (c, kind) in enumerate(dimensions))), "layout-values")
    bounds = steps(narrow, [f"v{i}" for i in range(k)], side)
    coordinates = [reduce(lambda a, b: a + b, ((F.col(f"v{i}") >= F.lit(b)).cast("int") for b in own), F.lit(0)) for i, own in enumerate(bounds)]
    curve = narrow.select("key", interleave(coordinates, bits).alias("z"))
    placed = save(ordinals.numbered(curve, ["z", "key"], "position").withColumn("file", F.expr(f"position div {rows_per_file}")), "layout-rows")
    pairs = save(placed.groupBy("file", "z").agg(F.count("*").alias("n")), "layout-cells")

    own = [coordinate(F.col("z"), i, k, bits) for i in range(k)]
    lows, highs = [f"lo{i}" for i in range(k)], [f"hi{i}" for i in range(k)]
    files = pairs.groupBy("file").agg(*(F.min(c).alias(n) for c, n in zip(own, lows)), *(F.max(c).alias(n) for c, n in zip(own, highs)))
    cells = pairs.groupBy("z").agg(F.min("file").alias("first"), F.max("file").alias("last"))
    fixed = [i for i in range(k) if radius[i] == 0]
    boxes = files.groupBy(*lows, *highs).agg(F.count("*").alias("files"))
    for i in fixed:
        boxes = boxes.withColumn(f"g{i}", F.explode(F.sequence(f"lo{i}", f"hi{i}")))
    group = [f"g{i}" for i in fixed]
    cells = cells.select("*", *(own[i].alias(f"g{i}") for i in fixed))
    met = boxes.groupBy(*group).cogroup(cells.groupBy(*group)).applyInPandas(_meet(k, bits, radius), "z long, first long, last long, touched long, matching long")

    # a cell with many files meets them in parts, so that no task has all of a frequent cell's files
    parts = met.select("z", "touched", "matching", F.explode(F.sequence(F.expr(f"first div {_FILES}"), F.expr(f"last div {_FILES}"))).alias("part"))
    known = pairs.select("file", "z", F.expr(f"file div {_FILES}").alias("part")).join(parts.hint("merge"), ["z", "part"]).join(files.hint("merge"), "file").drop("part")
    out = placed.join(known.hint("merge"), ["file", "z"])
    return out.select(F.col("key").alias(key), "z", "position", "file", F.col("touched").alias("files_touched"), F.col("matching").alias("files_matching"), *lows, *highs)


def document_layout(documents: DataFrame, rows_per_file: int = 1000) -> DataFrame:
    """Documents by source, language, length in bytes and a date made of the id; a row asks for its own source and language and what is near in length and date.

    A null text counts as shorter than an empty one; a null id has no date, which counts as the smallest.
    """
    date = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 365
    rows = documents.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.octet_length(F.col("text").cast("string")).alias("length"), date.alias("date"))
    dimensions = [("source", "string"), ("lang", "string"), ("length", "number"), ("date", "number")]
    out = clustered(rows, "doc_id", dimensions, [0, 0, 2, 2], rows_per_file)
    bounds = F.concat_ws(",", *(F.col(f"{side}{i}").cast("string") for i in range(4) for side in ("lo", "hi")))
    return out.select("doc_id", "z", "position", "file", "files_touched", "files_matching", bounds.alias("file_bounds"))
