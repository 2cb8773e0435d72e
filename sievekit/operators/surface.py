"""Detection in SQL: a table function over texts, for LATERAL joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sievekit.functions import scalars
from sievekit.functions.rules import Rule
from sievekit.operators import detect, scanner
from sievekit.sources.shared import small_batches

COLUMNS = "line_number bigint, rule_id string, byte_start bigint, byte_end bigint, utf16_start bigint, utf16_end bigint, matched_content string, masked_snippet string, severity string, score int, grade string, category string"


def _score(rule: Rule, near: str) -> int:
    """As detect.described: the base with its tags' weights, less ten near a test word, more ten near a production word."""
    low = near.lower()
    points = rule.base + sum(scalars.TAG_WEIGHTS.get(t, 0) for t in set(rule.tags))
    points += 10 * any(w in low for w in scalars.PROD_WORDS) - 10 * any(w in low for w in scalars.TEST_WORDS)
    return max(0, min(100, points))


def _grade(points: int) -> str:
    return next((name for name, least in (("Critical", 90), ("High", 70), ("Medium", 40)) if points >= least), "Low")


def register(spark: SparkSession, rules: list[Rule], name: str = "scan_text", marker: str = detect.MARKER, mode: str = "redact", placeholder: str = "<REDACTED>") -> None:
    """After this, SELECT ... FROM documents, LATERAL scan_text(text) gives the findings of each text; a null or empty text has none.

    The function in SQL unpacks what one in Python finds in whole Arrow batches of texts.
    """
    hide = scanner.hiding(mode, placeholder)
    fields = [f.split() for f in COLUMNS.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def found_in(data: np.ndarray, offs: np.ndarray, own: scanner.Scanner) -> Iterator[tuple[int, tuple]]:
        """(row, finding), by row."""
        found, (starts, stops, firsts) = own.scan(data, offs)
        for one in found:
            octets, units = scanner.places(one.text, one.spans)
            snippet, at = scanner.masked(one.text, one.spans, hide), int(firsts[one.row]) + one.number
            for start, stop, number in one.spans:
                rule = rules[number]
                before = [data[starts[k] : stops[k]].tobytes().decode() for k in range(at - min(one.number, rule.context_lines_before), at)]
                points = _score(rule, "\n".join([one.text, *before, ""]))
                yield one.row, (one.number + 1, rule.id, octets[start], octets[stop], units[start], units[stop], one.text[start:stop], snippet, rule.severity, points, _grade(points), rule.category)

    def scan(texts):  # no annotations: they would have to be names that a worker finds
        own, rows, found = scanner._scanner(rules, marker), [], []
        for lo, _, data, offs in scanner._chunks(pa.record_batch([texts], names=["text"]), 0):
            for row, one in found_in(data, offs, own):
                rows.append(lo + row)
                found.append(one)
        columns = list(zip(*found)) if found else [[]] * len(fields)
        inner = pa.StructArray.from_arrays([pa.array(v, types[kind]) for v, (_, kind) in zip(columns, fields)], [f for f, _ in fields])
        edges = np.concatenate([[0], np.cumsum(np.bincount(np.array(rows, np.int64), minlength=len(texts)))])
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), inner)

    small_batches(spark)
    struct = ",".join(f"{f}:{kind}" for f, kind in fields)
    spark.udf.register(f"{name}__found", F.arrow_udf(scan, f"array<struct<{struct}>>", F.ArrowUDFType.SCALAR))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS TABLE({COLUMNS}) RETURN SELECT f.* FROM (SELECT explode({name}__found(text)) AS f)")
