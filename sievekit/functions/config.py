"""Configurations: layers of which the later ones win, and checks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.functions.rules import PATTERN_LIMIT, SEVERITIES

#: Bounds of numbers: section, field, smallest, largest.
BOUNDS = (("core", "max_file_size", 1, 500 << 20), ("core", "max_file_count", 1, 1_000_000), ("output", "max_findings", 1, 100_000))


def merged(*layers: dict) -> dict:
    """Layers from the first to the last: lists are joined, sections and rules merge by field, any other value of a later layer wins.

    A rule that a later layer gives a pattern is that layer's alone.
    """
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            if key == "rules":
                rules = out.setdefault("rules", {})
                for id_, rule in value.items():
                    rules[id_] = dict(rule) if "pattern" in rule else {**rules.get(id_, {}), **rule}
            elif isinstance(value, dict):
                out[key] = merged(out.get(key, {}), value)
            elif isinstance(value, list):
                out[key] = [*out.get(key, []), *value]
            elif value is not None:
                out[key] = value
    return out


def layered(layers: list[DataFrame], key: str) -> DataFrame:
    """The relational form: tables of one schema joined by key, of each column the value of the last layer that has one."""

    def over(low: DataFrame, high: DataFrame) -> DataFrame:
        names = [c for c in low.columns if c != key]
        both = low.alias("low").join(high.alias("high"), key, "full")
        return both.select(key, *(F.coalesce(F.col(f"high.{c}"), F.col(f"low.{c}")).alias(c) for c in names))

    return reduce(over, layers)


def problems(config: dict) -> list[str]:
    """What a configuration from a file may not say."""
    out = []
    if config.get("output", {}).get("mask_mode") == "plain":
        out.append("output.mask_mode: plain output is for the command line alone")
    for section, name, least, most in BOUNDS:
        value = config.get(section, {}).get(name)
        if value is not None and not least <= value <= most:
            out.append(f"{section}.{name}: not within {least} to {most}")
    for id_, rule in config.get("rules", {}).items():
        pattern = rule.get("pattern")
        if pattern is not None:
            if not pattern:
                out.append(f"{id_}: empty pattern")
            elif len(pattern) > PATTERN_LIMIT:
                out.append(f"{id_}: pattern longer than {PATTERN_LIMIT}")
            else:
                try:
                    re.compile(pattern.replace("(?-u:\\b)", "\\b"))
                except re.error as error:
                    out.append(f"{id_}: {error}")
        if "severity" in rule and rule["severity"].lower() not in [s.lower() for s in SEVERITIES]:
            out.append(f"{id_}: unknown severity")
    return out
