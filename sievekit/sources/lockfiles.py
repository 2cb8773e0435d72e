"""Lockfiles of four package managers as tables of packages."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from sievekit.sources.readers import npm_v1, pnpm_lock, yarn_lock

PACKAGES = "ecosystem string, name string, version string, location string"


def _cargo(content: str) -> list[tuple[str, str]]:
    return sorted({(p["name"], p["version"]) for p in tomllib.loads(content).get("package", [])})


def _npm(content: str) -> list[tuple[str, str]]:
    """The packages map where there is one (no root, no links), else nested dependencies; versions that begin with a digit."""
    raw = json.loads(content)
    if "packages" not in raw:
        return npm_v1(content)
    named = ((path.rsplit("node_modules/", 1)[-1], str(entry.get("version", ""))) for path, entry in raw["packages"].items() if path and not entry.get("link"))
    return sorted({(name, version) for name, version in named if version[:1].isdigit()})


#: File name, ecosystem and parser.
KINDS = {"Cargo.lock": ("Rust", _cargo), "package-lock.json": ("Npm", _npm), "pnpm-lock.yaml": ("Npm", pnpm_lock), "yarn.lock": ("Npm", yarn_lock)}


def packages(files: DataFrame) -> DataFrame:
    """ecosystem, name, version, location of every package in lockfiles (path, content), each once a file.

    Files of other names and null contents give nothing; a file that can't be parsed stops the job and is named.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                ecosystem, parse = KINDS.get(path.rsplit("/", 1)[-1], (None, None))
                if parse is None or content is None:
                    continue
                try:
                    out += [(ecosystem, name, version, path) for name, version in parse(content)]
                except ValueError as error:
                    raise ValueError(f"{path}: {error}") from None
            yield pd.DataFrame(out, columns=["ecosystem", "name", "version", "location"])

    return files.select("path", "content").mapInPandas(run, PACKAGES)
