"""Secret scans: an Aho-Corasick keyword prefilter, anchored patterns near the hits, embedded checks."""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm import textscan
from sievekit.llm.common import texts

SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Kind:
    """Keywords in lower case that begin a match, the pattern tried there, the check of what it finds.

    run: a pattern of which every match begins with one run; where the pattern fails, it fails at all hits within that run.
    """

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]
    run: re.Pattern | None = None


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def base62_crc32(body: str) -> str:
    """CRC-32 in six digits of base 62, as some issuers append it to their tokens."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _BASE62[digit] + out
    return out


def _has_checksum(m: re.Match) -> bool:
    return base62_crc32(m[1][:-6]) == m[1][-6:]


def _is_web_token(m: re.Match) -> bool:
    """A header that is JSON and names its algorithm."""
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, TypeError, binascii.Error, RecursionError):
        return False


KINDS = (
    Kind(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile("(" + "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        lambda m: len(m[2]) >= 6,
    ),
    Kind("access", ("akia",), re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile("gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _has_checksum),
    Kind("npm", ("npm_",), re.compile("npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _has_checksum),
    Kind("jwt", ("eyj",), re.compile(r"(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"), _is_web_token, re.compile("[A-Za-z0-9_-]++")),
    Kind("pem", ("-----begin ",), re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"), lambda m: True),
)
#: The order in which spans of one start are listed.
ORDER = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = ORDER[:3]
HEX_LEAST = 24

_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_automaton = None


def _hits(lowered: str) -> Iterator[tuple[int, int]]:
    """Where a keyword begins, and the number of its kind."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for k, kind in enumerate(KINDS):
            for word in kind.keywords:
                _automaton.add_word(word, (k, len(word)))
        _automaton.make_automaton()
    for last, (k, size) in _automaton.iter(lowered):
        yield last + 1 - size, k


def find(data: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each row its spans (start, number in ORDER, end) in code points, sorted."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offs) - 1)]
    raw = data.tobytes()
    text = raw.decode("utf-8")
    at = None if len(text) == len(raw) else np.flatnonzero((data & 0xC0) != 0x80)
    rows = offs if at is None else np.searchsorted(at, offs)
    found = sorted(_hits(textscan.lower_ascii(data).tobytes().decode("utf-8")))
    if found:
        row_of = (np.searchsorted(rows, [h[0] for h in found], "right") - 1).tolist()
        edge = rows.tolist()
        done = [0] * len(KINDS)
        for (start, k), row in zip(found, row_of):
            if start < done[k]:
                continue
            if m := KINDS[k].pattern.match(text, start, edge[row + 1]):
                done[k] = m.end()  # a match that fails its check still takes its characters
                if KINDS[k].valid(m):
                    out[row].append((start - edge[row], ORDER.index(KINDS[k].name), m.end() - edge[row]))
            elif KINDS[k].run:
                done[k] = KINDS[k].run.match(text, start, edge[row + 1]).end()
    # Long runs of hexadecimal digits have no keyword; they are runs of one byte class.
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _HEX[data]
    change = inside[1:] != inside[:-1]
    change[offs] |= inside[1:][offs] & inside[:-1][offs]  # a run that goes on in the next row ends and begins there
    points = np.flatnonzero(change)
    if len(points):
        starts = points[inside[1:][points]]
        ends = points[inside[:-1][points]]
        long = ends - starts >= HEX_LEAST
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            row = int(np.searchsorted(offs, s, "right")) - 1
            if at is not None:
                s, e = int(np.searchsorted(at, s)), int(np.searchsorted(at, e))
            out[row].append((s - int(rows[row]), ORDER.index("hex"), e - int(rows[row])))
    for spans in out:
        spans.sort()
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>>: the secrets of every whole text, by start and then by kind.

    Places are code points, the end exclusive.  Matches of one kind don't overlap, those of different kinds may.
    One row comes out for each row that goes in, repeated rows and null ids included; a null or empty text has
    no spans; other columns are ignored; an empty table gives an empty table.  Time grows with a text's length
    alone: no character is read by one pattern more than a few times.  A narrow operator: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textscan.buffer_of(batch.column(1))
            for lo, hi in textscan.row_chunks(offs):
                spans = find(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                flat = [s for row in spans for s in row]
                items = pa.StructArray.from_arrays([pa.array([ORDER[k] for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int32()), pa.array([e for _, _, e in flat], pa.int32())], names=["kind", "start", "end"])
                edges = np.concatenate([[0], np.cumsum([len(row) for row in spans])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), items)], names=["doc_id", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with each secret replaced by its kind in brackets; overlapping spans become one.

    A text without a secret, null included, stays as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            column = batch.column(k)
            data, offs = textscan.buffer_of(column)
            changed: dict[int, str] = {}
            for lo, hi in textscan.row_chunks(offs):
                for i, spans in enumerate(find(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]), lo):
                    if spans:
                        text, parts, at = column[i].as_py(), [], 0
                        for start, kind, end in spans:
                            if start >= at:
                                parts += [text[at:start], f"[{ORDER[kind]}]"]
                            at = max(at, end)
                        changed[i] = "".join([*parts, text[at:]])
            if changed:
                rows = column.to_pylist()
                for i, text in changed.items():
                    rows[i] = text
                column = pa.array(rows, column.type)
            yield pa.RecordBatch.from_arrays([column if j == k else batch.column(j) for j in range(batch.num_columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digests(documents: DataFrame) -> DataFrame:
    """Per document: spans of each base kind, SHA-256 of the base spans' list, all spans as a string."""
    found = scan(documents)

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
