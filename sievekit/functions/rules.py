"""Rules and rule packs: loading, checking, layering, and patterns in Spark's and in DuckDB's dialect."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, replace
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("Low", "Medium", "High", "Critical")
VALIDATORS = ("jp_address_prefecture_city_block", "jp_mynumber_len12", "jp_person_name_keyword", "jp_phone_mobile", "luhn")
#: Longest pattern that a pack or a configuration may hold.
PATTERN_LIMIT = 1024

RULE_SCHEMA = "id string, enabled boolean, pattern string, severity string, score int, base_score int, category string, tags array<string>, context_lines_before int, validator string, placeholder string"


class RuleError(ValueError):
    """A pack that can't be loaded."""


def parse_severity(text: str | None) -> str:
    """Pascal case; whatever is unknown counts as Medium."""
    word = (text or "").strip().lower()
    return next((s for s in SEVERITIES if s.lower() == word), "Medium")


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    severity: str = "Medium"
    score: int = 50
    enabled: bool = True
    base_score: int | None = None
    category: str = "other"
    tags: tuple[str, ...] = field(default=())
    context_lines_before: int = 0
    validator: str | None = None
    placeholder: str | None = None

    @property
    def normalises(self) -> bool:
        """Whether the rule also reads a line with full-width characters narrowed."""
        return self.id.startswith(("pii.jp.", "jp.")) or self.category == "jp_pii" or bool({"jp", "jp_pii"} & set(self.tags))

    @property
    def base(self) -> int:
        return self.base_score if self.base_score is not None else {"Low": 30, "Medium": 60, "High": 80, "Critical": 90}[self.severity]


def spark_pattern(pattern: str) -> str:
    """For Java: classes follow Unicode, but for boundaries that are ASCII alone."""
    edge = r"(?-u:\b)"
    if pattern.startswith(edge):
        pattern = "(?<![0-9A-Za-z_])" + pattern[len(edge) :]
    pattern = pattern.replace(edge, "(?![0-9A-Za-z_])")
    # the flag costs time at every character, so it is set only where something depends on it
    return "(?U)" + pattern if re.search(r"\\[bBdDsSwW]|\(\?[a-z]*i", pattern) else pattern


def required_words(pattern: str) -> tuple[str, ...]:
    """Literals of which every match holds one at least; empty if the pattern doesn't show any.

    Either the alternatives of the group that the pattern begins with, each up to its first character that isn't literal, or a
    character between two parts of the pattern that are there once or more.
    """
    if "(?i" in pattern:
        return ()
    if pattern.startswith("(?:"):
        depth, end = 1, 3
        while end < len(pattern) and depth:
            if pattern[end] == "\\":
                end += 1
            elif pattern[end] == "[":
                end = pattern.index("]", end + 2)
            else:
                depth += {"(": 1, ")": -1}.get(pattern[end], 0)
            end += 1
        inside = pattern[3 : end - 1]
        if pattern[end : end + 1] in ("?", "*", "{") or "|" not in inside or re.search(r"\((?!\?:\\s\*\|_\))", inside):
            return ()
        words = [re.match(r"[^\\\[\](){}.*+?|^$]*", w.removeprefix("\\b"))[0] for w in inside.replace(r"(?:\s*|_)", "\\").split("|")]
        # a literal that is followed by a quantifier may be missing its last character
        words = [w[:-1] if re.match(re.escape(w) + "[?*{]", part.removeprefix("\\b")) else w for w, part in zip(words, inside.replace(r"(?:\s*|_)", "\\").split("|"))]
        return tuple(words) if all(len(w) >= 2 for w in words) else ()
    sign = re.match(r"\[[^\]]+\]\+([@#])\[", pattern)
    return (sign[1],) if sign else ()


def duckdb_pattern(pattern: str) -> str:
    """For RE2, whose boundaries and classes are ASCII."""
    return pattern.replace(r"(?-u:\b)", r"\b")


def _rule(raw: dict, source: str) -> Rule:
    try:
        rule = Rule(
            id=raw["id"], pattern=raw["pattern"], severity=parse_severity(raw.get("severity")), score=int(raw.get("score", 50)), enabled=bool(raw.get("enabled", True)), base_score=raw.get("base_score"),
            category=raw.get("category", "other"), tags=tuple(raw.get("tags", ())), context_lines_before=int(raw.get("context_lines_before", 0)), validator=raw.get("validator"), placeholder=raw.get("placeholder"),
        )
    except KeyError as missing:
        raise RuleError(f"{source}: a rule lacks {missing}") from None
    if rule.validator and rule.validator not in VALIDATORS:
        raise RuleError(f"{source}: unknown validator {rule.validator}")
    if not rule.pattern or len(rule.pattern) > PATTERN_LIMIT and source == "configuration":
        raise RuleError(f"{source}: the pattern of {rule.id} is empty or too long")
    return rule


def load_pack(folder: str | Path, strict: bool = True) -> list[Rule]:
    """The rules of a folder: the files of 00_manifest.toml in its order, or all *.toml by name.

    strict: a file that is missing is an error, else it is passed over.  Two rules of one id are an error.
    """
    folder = Path(folder)
    manifest = folder / "00_manifest.toml"
    names = tomllib.loads(manifest.read_text("utf-8")).get("files") if manifest.exists() else None
    if names is not None:
        if bad := [n for n in names if "/" in n and (".." in n.split("/") or n.startswith("/"))]:
            raise RuleError(f"unsafe file names: {bad}")
        files = [folder / n for n in names]
    else:
        files = sorted(p for p in folder.glob("*.toml") if p != manifest)
    out: list[Rule] = []
    for path in files:
        if not path.exists():
            if strict:
                raise RuleError(f"{path.name} is missing")
            continue
        out += [_rule(raw, path.name) for raw in tomllib.loads(path.read_text("utf-8")).get("rules", [])]
    return unique(out)


def load_templates(folder: str | Path) -> list[Rule]:
    """All rules of all *.toml files below a folder, by path."""
    return unique([_rule(raw, str(p)) for p in sorted(Path(folder).rglob("*.toml")) if p.name != "00_manifest.toml" for raw in tomllib.loads(p.read_text("utf-8")).get("rules", [])])


def unique(rules: list[Rule]) -> list[Rule]:
    seen: set[str] = set()
    for rule in rules:
        if rule.id in seen:
            raise RuleError(f"two rules have the id {rule.id}")
        seen.add(rule.id)
    return rules


@cache
def builtin(pack: str = "pii") -> tuple[Rule, ...]:
    """A pack that comes with the engine: pii, creds or log."""
    path = Path(__file__).parent.parent / "rules" / f"{pack}.toml"
    return tuple(unique([_rule(raw, path.name) for raw in tomllib.loads(path.read_text("utf-8"))["rules"]]))


def override(rules: list[Rule], *packs: list[Rule], config: dict[str, dict] | None = None) -> list[Rule]:
    """Later packs replace rules of the same id.  A configured rule with a pattern replaces, one without patches some fields."""
    by_id = {r.id: r for pack in (rules, *packs) for r in pack}
    for id_, raw in (config or {}).items():
        if "pattern" in raw:
            by_id[id_] = _rule({"category": "custom", "context_lines_before": 2, **raw, "id": id_}, "configuration")
        elif id_ in by_id:
            patch = {k: raw[k] for k in ("score", "base_score", "category", "placeholder", "validator", "enabled") if k in raw}
            if "severity" in raw:
                patch["severity"] = parse_severity(raw["severity"])
            if "tags" in raw:
                patch["tags"] = tuple(raw["tags"])
            by_id[id_] = replace(by_id[id_], **patch)
    return [by_id[k] for k in sorted(by_id)]


def risky(pattern: str) -> bool:
    """Whether the pattern has a quantified group with a quantifier at its end, which may backtrack without end."""
    return any(part in pattern for part in ("+)+", "*)*", "+)*", "*)+"))


def to_frame(spark: SparkSession, rules) -> DataFrame:
    rows = [(r.id, r.enabled, r.pattern, r.severity, r.score, r.base_score, r.category, list(r.tags), r.context_lines_before, r.validator, r.placeholder) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def severity_rank(column):
    out = F.lit(None).cast("int")
    for k, name in enumerate(SEVERITIES):
        out = F.when(F.lower(column) == name.lower(), k).otherwise(out)
    return out
