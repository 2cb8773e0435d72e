"""Dependency traces: shortest paths from targets up to members, by a frontier that is joined with reversed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.sources.shared import forget, save


def traces(edges: DataFrame, targets: DataFrame, members: DataFrame, most_steps: int = 1000) -> DataFrame:
    """target, member, depth, path: for each target one shortest path from a member down to it; targets that no member reaches have no row.

    edges: parent, child.  targets, members: node.  Of the nodes a step away, each is reached through the smallest one; of the nearest members the smallest counts: so
    paths are unique.  A target that is a member is its own path.  Null nodes and repeated rows count for nothing.

    Each step is one shuffle of the frontier; nodes that were seen are told apart by target, a target that has met a member leaves the
    frontier, and the steps are kept as tables, so plans stay short and nothing is collected but whether the frontier is empty.
    """
    reverse = save(edges.filter("parent is not null and child is not null").select("parent", "child").distinct(), "trace-edges")
    ends = save(members.filter("node is not null").select("node").distinct(), "trace-members")
    frontier = save(targets.filter("node is not null").select(F.col("node").alias("target"), "node", F.lit(None).cast(targets.schema["node"].dataType).alias("next")).distinct(), "trace-0")
    steps, seen, met = [frontier], frontier.select("target", "node"), []
    for depth in range(most_steps + 1):
        hits = frontier.join(ends, "node", "left_semi").groupBy("target").agg(F.min("node").alias("member"), F.lit(depth).alias("depth"))
        met.append(save(hits, f"trace-met-{depth}"))
        open_ = frontier.join(met[-1].select("target"), "target", "left_anti")
        reached = open_.join(reverse, F.col("node") == F.col("child")).groupBy("target", F.col("parent").alias("node")).agg(F.min("child").alias("next"))
        frontier = save(reached.join(seen, ["target", "node"], "left_anti"), f"trace-{depth + 1}")
        if frontier.isEmpty():
            break
        steps.append(frontier)
        seen = seen.union(frontier.select("target", "node"))
    # from the members down again: at each step the node through which it was reached
    found = met[0]
    for more in met[1:]:
        found = found.union(more)
    paths = found.select("target", "member", "depth", F.col("member").alias("__at"), F.array("member").alias("path"))
    for depth in range(len(steps) - 1, 0, -1):
        step = steps[depth].select("target", F.col("node").alias("__at"), F.col("next").alias("__next"))
        on = paths.join(step, ["target", "__at"], "left")
        further = (F.col("depth") >= depth) & F.col("__next").isNotNull()
        paths = on.select("target", "member", "depth", F.when(further, F.col("__next")).otherwise(F.col("__at")).alias("__at"), F.when(further, F.concat("path", F.array("__next"))).otherwise(F.col("path")).alias("path"))
    out = save(paths.select("target", "member", "depth", "path"), "traces")
    for one in (reverse, ends, *steps, *met, frontier):
        forget(one)
    return out
