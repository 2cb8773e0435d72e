"""Sinks: reports, baselines, rule packs, evidence."""

from __future__ import annotations

import hashlib
import json
import os
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.functions.rules import Rule

# What a key holds whose texts are never written out, and what such a text holds.
SECRET_KEYS = ("password", "secret", "token", "api_key", "apikey", "authorization", "private_key", "access_key")
SECRET_MARKS = ("?token=", "&token=", "#token=", "access_token=", "api_key=", "apikey=", "client_secret=", "password=", "secret=", "authorization: bearer ")
SECRET_START = "bearer "


def write_atomic(path: str | Path, content: bytes) -> None:
    path = Path(path)
    part = path.with_name(f".{path.name}.{os.getpid()}.part")
    part.write_bytes(content)
    os.replace(part, path)


def write_findings(findings: DataFrame, path: str) -> None:
    findings.write.json(path)


def redacted(value, key: str = ""):
    """A configuration without texts whose key or whose content looks secret; lists are entered under their key, numbers and switches stay."""
    if isinstance(value, dict):
        return {k: redacted(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [redacted(v, key) for v in value]
    if not isinstance(value, str):
        return value
    low = value.lower()
    secret = any(w in key.lower() for w in SECRET_KEYS) or any(w in low for w in SECRET_MARKS) or low.lstrip().startswith(SECRET_START)
    return "<REDACTED>" if secret else value


def redacted_text(key: Column, value: Column) -> Column:
    """The same for a table of keys and texts; a null text stays null, and of a null key the text alone counts."""
    low = F.lower(value)
    secret = F.regexp_replace(low, r"^\s+", "").startswith(SECRET_START)
    for word in SECRET_MARKS:
        secret = secret | F.contains(low, F.lit(word))
    for word in SECRET_KEYS:
        secret = secret | F.coalesce(F.contains(F.lower(key), F.lit(word)), F.lit(False))
    return F.when(value.isNotNull() & secret, F.lit("<REDACTED>")).otherwise(value)


def toml_string(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def write_pack(rules: list[Rule], folder: str | Path, id_: str, version: int = 1) -> str:
    """A folder that load_pack reads, and the SHA-256 over its files in the manifest's order."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    digest, names = hashlib.sha256(), []
    for rule in rules:
        fields = {"id": rule.id, "pattern": rule.pattern, "severity": rule.severity, "category": rule.category, "validator": rule.validator, "placeholder": rule.placeholder}
        lines = ["[[rules]]", *(f"{k} = {toml_string(v)}" for k, v in fields.items() if v is not None), f"score = {rule.score}", f"enabled = {str(rule.enabled).lower()}", f"context_lines_before = {rule.context_lines_before}", f"tags = [{', '.join(map(toml_string, rule.tags))}]"]
        if rule.base_score is not None:
            lines.append(f"base_score = {rule.base_score}")
        content = ("\n".join(lines) + "\n").encode()
        names.append(f"{rule.id}.toml")
        write_atomic(folder / names[-1], content)
        digest.update(f"{names[-1]} {hashlib.sha256(content).hexdigest()}\n".encode())
    manifest = f"files = [{', '.join(map(toml_string, names))}]\n\n[pack]\nid = {toml_string(id_)}\nversion = {version}\nschema_version = 1\n"
    write_atomic(folder / "00_manifest.toml", manifest.encode())
    return digest.hexdigest()


def write_evidence(path: str | Path, parts: dict[str, bytes]) -> dict:
    """A ZIP of the parts and run_meta.json with the size and SHA-256 of each."""
    meta = {"artifacts": [{"path": n, "sha256": hashlib.sha256(b).hexdigest(), "size": len(b)} for n, b in sorted(parts.items())]}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in sorted(parts.items()):
            z.writestr(name, content)
        z.writestr("run_meta.json", json.dumps(meta, indent=1))
    return meta


def verify_evidence(path: str | Path, size_limit: int = 64 << 20) -> list[str]:
    """What is wrong with an evidence ZIP: unsafe names, sizes, missing, extra or changed parts, leaked tokens."""
    import re

    problems = []
    leak = re.compile(r"(?i)(#token=|\?token=|Authorization:\s*Bearer\s+[A-Za-z0-9._~-]{16,})")
    with zipfile.ZipFile(path) as z:
        infos = {i.filename: i for i in z.infolist()}
        if bad := [n for n in infos if n.startswith("/") or ".." in n.split("/") or "\\" in n]:
            return [f"unsafe path: {n}" for n in bad]
        if sum(i.file_size for i in infos.values()) > size_limit:
            return ["too large"]
        if "run_meta.json" not in infos:
            return ["run_meta.json is missing"]
        declared = {a["path"]: a for a in json.loads(z.read("run_meta.json"))["artifacts"]}
        problems += [f"missing: {n}" for n in sorted(declared.keys() - infos.keys())]
        problems += [f"extra: {n}" for n in sorted(infos.keys() - declared.keys() - {"run_meta.json"})]
        for name in sorted(declared.keys() & infos.keys()):
            content = z.read(name)
            if len(content) != declared[name]["size"] or hashlib.sha256(content).hexdigest() != declared[name]["sha256"]:
                problems.append(f"changed: {name}")
            if leak.search(content.decode("utf-8", "ignore")):
                problems.append(f"leak: {name}")
    return problems
