"""Evidence as tables: what text may not hold, closed schemas of JSON objects, declared against found artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folders of a machine that evidence may not name.
HOME_FOLDERS = ("Users", "home", "etc", "var", "private", "Volumes", "mnt")

#: A file URL, a step to the parent folder, a drive or a folder of a machine, at the start of a token.
FORBIDDEN = r"(^|[ \t\n\r\"'`])(\.\./|[A-Za-z]:[\\/]|/(" + "|".join(HOME_FOLDERS) + r")/|[Ff][Ii][Ll][Ee]:[/\\]+([^ \t\n\r/\\]|\z))"

_TYPES = {"string": ("STRING",), "bool": ("BOOLEAN",), "count": ("BIGINT", "TINYINT", "SMALLINT", "INT"), "object": ("OBJECT",), "array": ("ARRAY",)}


def forbidden(text: Column) -> Column:
    """Whether a text names places of the machine that wrote it; a text with a zero byte near its start is no text."""
    return ~F.contains(F.substring(text, 1, 512), F.lit("\x00")) & text.rlike(FORBIDDEN)


def schema_problems(text: Column, required: dict[str, str], optional: dict[str, str] | None = None) -> Column:
    """Sorted array of what is wrong with a JSON object: `missing x`, `unknown x`, `bad x`, or `no object`.

    Types are string, bool, count (a whole number from 0), object and array; a field that isn't named is unknown.
    An optional field may be null.
    """
    optional = optional or {}
    known = {**required, **optional}
    value = F.try_parse_json(text)
    keys = F.json_object_keys(text)
    problems = [F.when(~F.array_contains(keys, name), F.lit(f"missing {name}")) for name in required]
    for name, kind in known.items():
        own = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
        fits = F.regexp_extract(own, "^[A-Z]+", 0).isin(*_TYPES[kind])
        if kind == "count":
            fits = fits & (F.try_variant_get(value, f"$.{name}", "bigint") >= 0)
        if name in optional:
            fits = fits | (own == "VOID")
        problems.append(F.when(F.array_contains(keys, name) & ~F.coalesce(fits, F.lit(False)), F.lit(f"bad {name}")))
    strange = F.transform(F.filter(keys, lambda k: ~k.isin(*known)), lambda k: F.concat(F.lit("unknown "), k))
    return F.when(keys.isNull(), F.array(F.lit("no object"))).otherwise(F.array_sort(F.concat(F.array_compact(F.array(*problems)), strange)))


def artifact_problems(declared: DataFrame, found: DataFrame) -> DataFrame:
    """path, problem: what a manifest (path, sha256, size) says and what is there (path, sha256, size) don't agree in: missing, extra or changed."""
    joined = declared.select("path", F.col("sha256").alias("said"), F.col("size").alias("long")).join(found.select("path", F.col("sha256").alias("now"), F.col("size").alias("is_long")), "path", "full")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("said").isNull(), "extra").when((F.col("said") != F.col("now")) | (F.col("long") != F.col("is_long")), "changed")
    return joined.select("path", problem.alias("problem")).filter("problem is not null")
