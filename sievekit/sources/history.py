"""Commits as tables: first-parent chains, and what a commit, a time or an index changes.

commits: sha, parent (the first parent; null for a root), time.  trees: sha, path, blob (the content's hash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.sources.shared import forget, save


def chains(commits: DataFrame, heads: DataFrame, most_doublings: int = 40) -> DataFrame:
    """head, sha, distance: every commit on the first-parent chain of each head (head), itself at distance 0.

    By doubling: after k rounds all commits within 2**k steps are known, so a chain of a million takes 20 joins.
    """
    jumps = save(commits.filter("sha is not null and parent is not null").select("sha", F.col("parent").alias("to")).dropDuplicates(["sha"]), "jumps-0")
    known = save(heads.filter("head is not null").select("head", F.col("head").alias("sha"), F.lit(0).cast("long").alias("distance")).distinct().join(commits.select("sha").distinct(), "sha", "left_semi").select("head", "sha", "distance"), "chain-0")
    for k in range(most_doublings):
        more = save(known.join(jumps, "sha").select("head", F.col("to").alias("sha"), (F.col("distance") + (1 << k)).alias("distance")), f"chain-more-{k}")
        if more.isEmpty():
            break
        grown = save(known.union(more), f"chain-{k + 1}")
        ahead = jumps.select(F.col("sha").alias("to"), F.col("to").alias("beyond"))
        doubled = save(jumps.join(ahead, "to").select("sha", F.col("beyond").alias("to")), f"jumps-{k + 1}")
        for old in (known, jumps, more):
            forget(old)
        known, jumps = grown, doubled
    return known


def _status(before: Column, after: Column) -> Column:
    """A, M or D of a path by its blobs; null where nothing changed."""
    return F.when(before.isNull(), "A").when(after.isNull(), "D").when(before != after, "M")


def differences(pairs: DataFrame, trees: DataFrame) -> DataFrame:
    """sha, path, status, blob: how the tree of each sha differs from that of its base; pairs: sha, base."""
    after = pairs.join(trees, "sha").select("sha", "path", F.col("blob").alias("after"))
    before = pairs.join(trees.withColumnRenamed("sha", "base"), "base").select("sha", "path", F.col("blob").alias("before"))
    both = before.join(after, ["sha", "path"], "full")
    return both.select("sha", "path", _status(F.col("before"), F.col("after")).alias("status"), F.coalesce("after", "before").alias("blob")).filter("status is not null")


def commit_changes(commits: DataFrame, trees: DataFrame, chosen: DataFrame) -> DataFrame:
    """What the chosen commits (sha) change against their first parents; a root has none and is left out."""
    pairs = commits.join(chosen.select("sha").distinct(), "sha", "left_semi").filter("parent is not null").select("sha", F.col("parent").alias("base")).distinct()
    return differences(pairs, trees)


def since_changes(commits: DataFrame, trees: DataFrame, heads: DataFrame, since) -> DataFrame:
    """What each commit changes that is on a head's first-parent chain and not older than `since`; roots are left out."""
    recent = chains(commits, heads).join(commits.filter(F.col("time") >= since).select("sha"), "sha", "left_semi")
    return commit_changes(commits, trees, recent)


def staged_changes(trees: DataFrame, index: DataFrame, head) -> DataFrame:
    """path, status, blob: how the index (path, blob) differs from the tree of `head`; without commits (null) all is added."""
    before = trees.filter(F.col("sha") == head).select("path", F.col("blob").alias("before"))
    both = before.join(index.select("path", F.col("blob").alias("after")), "path", "full")
    return both.select("path", _status(F.col("before"), F.col("after")).alias("status"), F.coalesce("after", "before").alias("blob")).filter("status is not null")


def scannable(changes: DataFrame, contents: DataFrame) -> DataFrame:
    """Added and modified paths with their content (blob, content), a shared blob once a path."""
    return changes.filter(F.col("status").isin("A", "M")).join(contents, "blob")
