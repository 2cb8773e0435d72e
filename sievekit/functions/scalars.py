"""Scalar functions on columns: lines, spans, masks, scores, validators, identities, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are narrowed, one for one.
WIDE = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ　－―‐‑–—：（）"
NARROW = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz ------:()"
# Words near a match that lower or raise its score, and what tags add.
TEST_WORDS = ("test", "example", "sample", "dummy", "mock", "sandbox", "テスト", "サンプル", "ダミー", "モック", "サンドボックス")
PROD_WORDS = ("prod", "production", "secret", "credential", "key", "password")
TAG_WEIGHTS = {"critical": 20, "pii": 10, "low_risk": -10}
SCORE_FLOORS = {"Low": 20, "Medium": 40, "High": 70, "Critical": 90}


def lines(text: Column) -> Column:
    """The lines of a text: \\n or \\r\\n ends one, and an end behind the last line makes no empty line."""
    parts = F.split(text, "\r?\n", -1)
    whole = F.when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(whole)


def normalise(text: Column) -> Column:
    return F.translate(text, WIDE, NARROW)


def contains_any(text: Column, words) -> Column:
    return F.coalesce(F.greatest(*(F.contains(text, F.lit(w)) for w in words)), F.lit(False))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, hit>>: all leftmost matches that don't overlap, in characters.

    What stands between matches and the matches themselves alternate, so the places are running sums of their lengths: one
    fold over numbers, so that a line with thousands of matches copies no text.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,stop:int,hit:string>>")
    steps = F.filter(F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h)), lambda n: n.isNotNull())
    stops = F.aggregate(steps, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))
    found = F.zip_with(stops, hits, lambda s, h: F.struct((s - F.length(h)).alias("start"), s.alias("stop"), h.alias("hit")))
    return F.when(F.size(hits) > 0, found).otherwise(empty)


def bytes_before(text: Column, chars: Column) -> Column:
    return F.octet_length(F.left(text, chars)).cast("long")


def utf16_before(text: Column, chars: Column) -> Column:
    return (F.octet_length(F.encode(F.left(text, chars), "UTF-16BE")) / 2).cast("long")


def partial_mask(text: Column) -> Column:
    return F.when(F.length(text) <= 4, F.lit("****")).otherwise(F.concat(F.lit("****"), F.right(text, F.lit(4))))


def nearby(text: Column) -> Column:
    """Ten less near a test word, ten more near a production word."""
    low = F.lower(text)
    return F.when(contains_any(low, PROD_WORDS), 10).otherwise(0) - F.when(contains_any(low, TEST_WORDS), 10).otherwise(0)


def score(base: Column, tags: Column, near: Column) -> Column:
    """The base with its tags' weights and what is nearby, within 0 to 100."""
    weights = F.lit(0)
    for tag, weight in TAG_WEIGHTS.items():
        weights = weights + F.size(F.array_intersect(tags, F.array(F.lit(tag)))) * weight
    return F.greatest(F.lit(0), F.least(F.lit(100), base + weights + nearby(near))).cast("int")


def grade(points: Column) -> Column:
    return F.when(points >= 90, "Critical").when(points >= 70, "High").when(points >= 40, "Medium").otherwise("Low")


def strict_grade(points: Column) -> Column:
    """As grade, with Safe below ten."""
    return F.when(points < 10, "Safe").otherwise(grade(points))


def fingerprint(*parts: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def csv_cell(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_key(text: Column) -> Column:
    """A name that any file system takes: letters, digits and ._- stay, all else becomes _.

    What was changed or has over 128 characters ends in 16 digits of its SHA-256 behind 64 characters at most, so that two keys don't meet.
    """
    safe = F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")
    return F.when((safe != text) | (F.length(safe) > 128), F.concat(F.left(safe, F.lit(64)), F.lit("-"), F.left(F.sha2(text, 256), F.lit(16)))).otherwise(safe)


def package_of_path(path: Column) -> Column:
    return F.regexp_replace(path, "^.*node_modules/", "")


def package_of_selector(selector: Column) -> Column:
    return F.regexp_extract(selector, "^(@?[^@]+)", 1)


# ---- Validators that SQL can express -----------------------------------------------------------


def luhn_digits(digits: Column) -> Column:
    """Luhn's sum of a string of digits is a multiple of ten."""
    each = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return digits.rlike("^[0-9]+$") & (F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0)


def mynumber_length(text: Column) -> Column:
    """Whether some run of digits, with separators inside, has exactly twelve."""
    digits = F.translate(text, WIDE[:10], NARROW[:10])
    joined = F.regexp_replace(digits, "(?<=[0-9])[ \t　\\-－―‐‑–—ー]+(?=[0-9])", "")
    return F.exists(F.split(joined, "[^0-9]+"), lambda x: F.length(x) == 12)


def mobile_number(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, WIDE[:10], NARROW[:10]), "[^0-9]", "").rlike("^0[789]0[0-9]{8}$")


# ---- Dates ---------------------------------------------------------------------------------------


def tokyo_week(ts_utc: Column) -> Column:
    """ISO week of a UTC time in Tokyo, as 2024-W01."""
    local = ts_utc.cast("timestamp_ntz") + F.expr("INTERVAL 9 HOURS")
    return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), local).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(local).cast("string"), 2, "0"))


def week_monday(ts_utc: Column) -> Column:
    local = ts_utc.cast("timestamp_ntz") + F.expr("INTERVAL 9 HOURS")
    return F.to_date(F.date_trunc("week", local))


def valid_week(week: Column) -> Column:
    return F.coalesce(week.rlike("^[0-9]{4}-W(0[1-9]|[1-4][0-9]|5[0-3])$"), F.lit(False))


def expiry_seconds(text: Column) -> Column:
    """<number><d|w|y|h|m> in seconds; y is 365 days, m is minutes; null for anything else."""
    unit = {"d": 86400, "w": 604800, "y": 31536000, "h": 3600, "m": 60}
    size = F.lit(None).cast("long")
    for letter, seconds in unit.items():
        size = F.when(F.regexp_extract(text, "^([0-9]+)([dwyhm])$", 2) == letter, seconds).otherwise(size)
    return F.regexp_extract(text, "^([0-9]+)([dwyhm])$", 1).try_cast("bigint") * size


def freshness(age_seconds: Column) -> Column:
    return F.when(age_seconds <= 86400, "fresh").when(age_seconds <= 8 * 86400, "stale").otherwise("expired")


def backoff_ms(attempt: Column) -> Column:
    return F.least(F.lit(2000.0), 200 * F.pow(F.lit(2.0), attempt - 1)).cast("long")
