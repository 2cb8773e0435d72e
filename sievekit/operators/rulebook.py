"""Rules as tables (id, pattern, severity, score, category, variant, enabled ...): lists, filters, counts, overrides, lint.

`functions.rules` has the same for the rules of one pack; here a table may hold those of many packs and owners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.functions.rules import SEVERITIES, severity_rank

# Other names of severities, and what a configured rule is where it says nothing.
ALIASES = {"med": "Medium", "crit": "Critical"}
DEFAULTS = {"severity": "Medium", "score": 50, "category": "custom"}
_RISKY = ("+)+", "*)*", "+)*", "*)+")


def severity(text: Column, aliases: bool = True) -> Column:
    """A severity as it is written here; short names count where they are asked for, what is unknown or null is null."""
    word = F.lower(F.trim(text))
    known = {s.lower(): s for s in SEVERITIES} | (ALIASES if aliases else {})
    return F.coalesce(*(F.when(word == short, F.lit(name)) for short, name in known.items()))


def listed(rules: DataFrame, least: str = "Low") -> DataFrame:
    """The rules from a severity on; a rule without a known severity isn't listed."""
    return rules.filter(severity_rank(F.col("severity")) >= SEVERITIES.index(least))


def enabled(rules: DataFrame) -> DataFrame:
    """What a scanner loads: rules that are on; null is off."""
    return rules.filter(F.coalesce("enabled", F.lit(False)))


def explained(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each id asked for, `known` or not, with what its rule says; ids are asked for once however often they are named."""
    return ids.select("id").distinct().join(rules.withColumn("__is", F.lit(True)), "id", "left").withColumn("known", F.col("__is").isNotNull()).drop("__is")


def chosen(rules: DataFrame, categories=(), variants=(), severities=(), scores: tuple[int, int] | None = None) -> DataFrame:
    """The rules that meet every filter; an empty list filters nothing, a null meets no list."""
    for column, wanted in (("category", categories), ("variant", variants), ("severity", severities)):
        if wanted:
            rules = rules.filter(F.col(column).isin(*wanted))
    return rules if scores is None else rules.filter(F.col("score").between(*scores))


def counts(rules: DataFrame) -> DataFrame:
    """How many rules there are of each category, variant and severity, in one pass: facet, value (null is one), n."""
    facets = [F.col(c) for c in ("category", "variant", "severity")]
    sets = rules.groupingSets([[f] for f in facets], *facets).agg(F.grouping_id().alias("__set"), F.count("*").alias("n"))
    # a bit of the number is set for each column that is not of the set
    facet = F.when(F.col("__set") == 0b011, "category").when(F.col("__set") == 0b101, "variant").otherwise("severity")
    return sets.select(facet.alias("facet"), F.coalesce(*facets).alias("value"), "n")


def overridden(rules: DataFrame, configured: DataFrame) -> DataFrame:
    """Rules with what is configured on top (id, pattern, severity, score, category; null: not said), a row for each id.

    With a pattern it is a rule of its own, and what it doesn't say is by default; without one it changes what it says of the rule of its id, and does nothing where there is none.
    Both tables have an id once; an unknown severity that is said counts as Medium.
    """
    said = F.when(F.col("c.severity").isNotNull(), F.coalesce(severity(F.col("c.severity"), aliases=False), F.lit("Medium")))
    own = F.col("c.pattern").isNotNull()
    pick = lambda name, new: F.when(own, F.coalesce(new, F.lit(DEFAULTS[name]))).otherwise(F.coalesce(new, F.col(f"r.{name}"))).alias(name)
    both = rules.alias("r").join(configured.alias("c"), F.col("r.id") == F.col("c.id"), "full").filter(F.col("r.id").isNotNull() | own)
    return both.select(F.coalesce("r.id", "c.id").alias("id"), F.coalesce("c.pattern", "r.pattern").alias("pattern"), pick("severity", said), pick("score", F.col("c.score")), pick("category", F.col("c.category")))


def missing(required: DataFrame, rules: DataFrame) -> DataFrame:
    """The required ids that no rule has."""
    return required.select("id").distinct().join(rules.select("id"), "id", "left_anti")


def repeated(rules: DataFrame) -> DataFrame:
    """The ids of more than one rule, which a pack may not have."""
    return rules.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def risky(pattern: Column) -> Column:
    """Whether a pattern has a quantified group with a quantifier at its end, which may backtrack without end."""
    out = F.lit(False)
    for part in _RISKY:
        out = out | F.contains(pattern, F.lit(part))
    return out
