"""Presets: named changes of rules that lie below a configuration, and which of them fits a listing of files."""

from __future__ import annotations

import tomllib
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.functions import config as C
from sievekit.functions.rules import Rule, RuleError, override

# What shows which preset fits.
LOG_FOLDER, LOG_ENDINGS = "logs", ("log", "jsonl", "ndjson")
FINANCE_FOLDERS = ("payments", "billing", "kyc", "account")
_KANA = "[\\u3040-\\u30ff\\uff66-\\uff9f]"


@cache
def builtin() -> dict[str, dict]:
    """The presets that come with the engine, by name."""
    return tomllib.loads((Path(__file__).parent.parent / "rules" / "presets.toml").read_text("utf-8"))


def problems(preset: dict) -> list[str]:
    """What a preset may not say: it has rules, and each rule is switched, scored or both, and nothing else."""
    out = [] if preset else ["no rules"]
    for id_, said in preset.items():
        out += [f"{id_}: unknown {k}" for k in said if k not in ("enabled", "base_score")]
        out += [] if "enabled" in said or "base_score" in said else [f"{id_}: says nothing"]
    return out


def applied(rules: list[Rule], name: str, config: dict[str, dict] | None = None) -> list[Rule]:
    """The rules under a preset, with a configuration's rules on top of it.

    A preset needs all its rules: one that isn't loaded is an error, as its scores would silently not count.
    """
    if name not in builtin():
        raise RuleError(f"no preset {name}; there are {', '.join(sorted(builtin()))}")
    preset = builtin()[name]
    if absent := sorted(preset.keys() - {r.id for r in rules} - {i for i, c in (config or {}).items() if "pattern" in c}):
        raise RuleError(f"the preset {name} needs the rules {', '.join(absent)}")
    return override(rules, config=C.merged({"rules": preset}, {"rules": config or {}})["rules"])


def inferred(files: DataFrame, root: str = "root") -> DataFrame:
    """The preset that fits each root, or null; files: root, path (relative, with / between), text.

    Logs come first (a folder of that name, or a log at the top), then folders of finance at the top, then a README.md at the top with kana.
    Only one row a root and task moves; a null path shows nothing.
    """
    path, folder, top = F.col("path"), F.substring_index("path", "/", 1), ~F.contains("path", F.lit("/"))
    inside = ~top
    log = (inside & (folder == LOG_FOLDER)) | (top & F.regexp_extract(path, r"[^.]\.([^.]+)$", 1).isin(*LOG_ENDINGS))
    finance = inside & folder.isin(*FINANCE_FOLDERS)
    kana = (path == "README.md") & F.col("text").rlike(_KANA)
    shown = [F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in (("logs", log), ("finance", finance), ("kana", kana))]
    return files.groupBy(root).agg(*shown).select(root, F.when(F.col("logs"), "logs-jp").when(F.col("finance"), "fintech-jp").when(F.col("kana"), "standard-jp").alias("preset"))
