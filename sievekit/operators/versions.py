"""Versions as sortable keys, requirements as ranges of them, and packages joined to advisories by range.

A key is a string whose byte order is the order of versions: numbers in 20 digits, then a mark that puts a pre-release below its release, then the pre-release's
parts, numbers below words and shorter below longer.  Build metadata doesn't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below and above all keys.
LEAST, MOST = "", "~"
RANGE = "struct<low:string,high:string,pre:array<string>>"
#: First major versions of the stretches, after 0, by which packages and advisories of a name are dealt.
STRETCHES = (1, 2, 3, 4, 8, 16, 64, 1024)
_FULL = r"^\s*[v=]?\s*([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]*)?\s*$"


def _digits(text: Column) -> Column:
    return F.lpad(F.coalesce(text, F.lit("")), 20, "0")


def _core(major: Column, minor: Column, patch: Column) -> Column:
    return F.concat(_digits(major), _digits(minor), _digits(patch))


def _fields(version: Column) -> Column:
    """Major, minor, patch and pre-release as they are written, empty where they are not; null for what is no version."""
    said = F.regexp_replace(version, _FULL, "$1\x01$2\x01$3\x01$4")
    return F.when(said != version, F.split(said, "\x01"))  # what matches has no such mark, so it never stays as it was


def _fields_of_many(version: Column) -> Column:
    """As _fields, for many rows: three numbers with dots between them, as most versions are, are cut at the dots, and only others meet the pattern."""
    cut = F.split(version, "\\.")
    plain = (F.translate(version, "0123456789", "") == "..") & (cut[0] != "") & (cut[1] != "") & (cut[2] != "")
    return F.when(plain, F.concat(cut, F.array(F.lit("")))).otherwise(_fields(version))


def _core_of(fields: Column) -> Column:
    return F.when(fields.isNotNull(), _core(fields[0], fields[1], fields[2]))


def _key_of(fields: Column) -> Column:
    parts = F.transform(F.split(fields[3], "\\."), lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("0"), _digits(p))).otherwise(F.concat(F.lit("1"), p)))
    return F.concat(_core_of(fields), F.when(fields[3] == "", F.lit("~")).otherwise(F.concat(F.lit("-"), F.array_join(parts, "\x01"), F.lit("\x01"))))


def _with(value: Column, f) -> Column:
    """f of a value that is made once, however often f speaks of it."""
    return F.transform(F.array(value), f)[0]


def core(version: Column) -> Column:
    """Major, minor and patch, 20 digits each; null for what is no version."""
    return _with(_fields(version), _core_of)


def pre_release(version: Column) -> Column:
    return F.regexp_extract(version, _FULL, 4)


def key(version: Column) -> Column:
    """A version's sortable key; null for what is no version."""
    return _with(_fields(version), _key_of)


def _release(major: Column, minor: Column, patch: Column) -> Column:
    """The key below which everything older than a release lies, its own pre-releases included."""
    return F.concat(_core(*(c.cast("string") for c in (major, minor, patch))), F.lit("-"))


def _said(comparator: Column) -> Column:
    """A comparator's sign and its version's fields."""
    text = F.regexp_replace(comparator, r"^\s*[<>=^~]*\s*", "")
    return F.struct(F.trim(comparator).isin("*", "").alias("every"), F.regexp_extract(comparator, r"^\s*([<>=^~]*)", 1).alias("op"), _fields(text).alias("fields"))


def _read(said: Column) -> Column:
    fields = said["fields"]
    number = lambda k: F.coalesce(fields[k].try_cast("bigint"), F.lit(0))
    return F.struct(
        said["every"].alias("every"), said["op"].alias("op"), (said["every"] | fields.isNotNull()).alias("known"), (fields[1] != "").alias("has_minor"), (fields[2] != "").alias("has_patch"),
        number(0).alias("major"), number(1).alias("minor"), number(2).alias("patch"), _key_of(fields).alias("own"), F.when(fields[3] != "", _core_of(fields)).alias("pre"),
    )


def _bounds(read: Column) -> Column:
    op, every, own, major, minor, patch = (read[c] for c in ("op", "every", "own", "major", "minor", "patch"))
    has_minor, has_patch = read["has_minor"], read["has_patch"]
    zero, least, most = F.lit(0), F.lit(LEAST), F.lit(MOST)
    next_major, next_minor, next_patch = _release(major + 1, zero, zero), _release(major, minor + 1, zero), _release(major, minor, patch + 1)
    after = F.when(~has_minor, next_major).when(~has_patch, next_minor).otherwise(F.concat(own, F.lit("\x00")))  # behind all that a short version stands for
    start = F.when(has_patch, own).otherwise(_release(major, minor, patch))
    caret = F.when(~has_minor | (major > 0), next_major).when(~has_patch | (minor > 0), next_minor).otherwise(next_patch)
    tilde = F.when(~has_minor, next_major).otherwise(next_minor)
    low = F.when(op.isin("<", "<="), least).when(op == ">", after).otherwise(start)
    high = F.when(op.isin(">", ">="), most).when(op == "<", start).when(op.isin("<=", "="), after).when(op == "~", tilde).otherwise(caret)
    return F.when(read["known"], F.struct(F.when(every, least).otherwise(low).alias("low"), F.when(every, most).otherwise(high).alias("high"), F.when(~every, read["pre"]).alias("pre")))


def requirement(text: Column) -> Column:
    """The range of keys that meet all comparators (">= 2.0.0, < 2.1.3", ^1.2, ~1.2, =1.2, *); null where one of them isn't understood.

    pre: numbers of which pre-releases count, as one of the comparators names one of them.
    """
    # each step is a transform of its own, so that what one makes stands in the next by name and not as a copy
    each = F.transform(F.transform(F.transform(F.split(text, ","), _said), _read), _bounds)

    def joint(e: Column) -> Column:
        both = F.struct(F.array_max(F.transform(e, lambda b: b["low"])).alias("low"), F.array_min(F.transform(e, lambda b: b["high"])).alias("high"), F.array_compact(F.transform(e, lambda b: b["pre"])).alias("pre"))
        return F.when(~F.exists(e, lambda b: b.isNull()), both)

    return _with(each, joint)


def _within(k: Column, bounds: Column) -> Column:
    """Whether a key lies in a range; that of a pre-release only where the range names one of the same numbers."""
    return F.coalesce((k >= bounds["low"]) & (k < bounds["high"]) & ((F.substring(k, 61, 1) == MOST) | F.array_contains(bounds["pre"], F.substring(k, 1, 60))), F.lit(False))


def inside(version: Column, bounds: Column) -> Column:
    """Whether a version lies in a range; a pre-release only where the range names one of the same numbers."""
    return _with(key(version), lambda k: _within(k, bounds))


def satisfies(version: Column, text: Column) -> Column:
    return inside(version, requirement(text))


def _stretch(k: Column) -> Column:
    """The number of the stretch of major versions that a key, or the end of a range, lies in."""
    out = F.when(k < f"{STRETCHES[0]:020}", 0)
    for number, first in enumerate(STRETCHES[1:], 1):
        out = out.when(k < f"{first:020}", number)
    return out.otherwise(len(STRETCHES))


def vulnerable(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """A row for each package and advisory of its name whose range holds its version; packages: name, version and more, advisories: crate_name, vulnerable_versions and more.

    Each distinct requirement is read once, however many advisories have it, and each package's version once; packages are read and moved once.  Both sides are joined by name and
    stretch of major versions (STRETCHES), so a name with many of both is dealt to several tasks; an advisory goes to the stretches that its range touches, a fixed number at most.
    """
    # the text to be read is a result of the grouping, so that no filter on the range is made a filter on every advisory
    asked = advisories.groupBy("vulnerable_versions").agg(F.max("vulnerable_versions").alias("__text"))
    ranges = asked.select("vulnerable_versions", requirement(F.col("__text")).alias("__range")).filter("__range is not null")
    ranged = advisories.join(ranges, "vulnerable_versions").select(*advisories.columns, "__range", F.explode(F.array(*map(F.lit, range(len(STRETCHES) + 1)))).alias("__part"))
    low, high = F.col("__range.low"), F.col("__range.high")
    # one condition that needs the stretch, so that no part of it is made a filter below, where it would read requirements again
    dealt = ranged.filter(F.when(low < high, F.col("__part").between(_stretch(low), _stretch(high))))
    # what is no version has an empty key, which no range holds; as that is never null, no filter makes the keys a second time
    fields = packages.withColumn("__fields", _fields_of_many(F.col("version")))
    keyed = fields.withColumn("__key", F.coalesce(_key_of(F.col("__fields")), F.lit(""))).drop("__fields").withColumn("__of", _stretch(F.col("__key")))
    hits = keyed.join(dealt, (F.col("name") == F.col("crate_name")) & (F.col("__of") == F.col("__part"))).filter(_within(F.col("__key"), F.col("__range")))
    rest = [c for c in packages.columns if c not in ("name", "version")]
    return hits.select("name", "version", *rest, *(c for c in advisories.columns if c != "crate_name"))


def least_fixed(found: DataFrame, fixed: str = "fixed") -> DataFrame:
    """The smallest fixed version above the one in use; found: name, version, fixed (array of versions).  A pre-release is below its release."""
    each = found.select("name", "version", F.explode(fixed).alias("fixed")).filter(key(F.col("fixed")) > key(F.col("version")))
    return each.groupBy("name", "version").agg(F.min_by("fixed", F.struct(key(F.col("fixed")), "fixed")).alias("fixed"))
