"""Whole texts against whole packs in one pass.

A batch of texts is one UTF-8 buffer.  What each rule asks of a line (patterns.needs) is found for all lines at once: literals by
searching the buffer, numbers of digits and signs by sums over it.  A line meets only the rules whose needs it holds, so most lines never become strings, and a rule costs
nothing where its words aren't.  Places in bytes and UTF-16 units, and masked lines, are made by one walk along a line's matches, so a
line of a megabyte full of matches takes time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sievekit.functions import patterns, scalars, validators
from sievekit.functions.rules import Rule
from sievekit.sources.shared import small_batches

#: Bytes of text that are searched at once; a longer text is searched whole.
CHUNK_BYTES = 1 << 20
_CHECKS = {"luhn": validators.luhn, "jp_address_prefecture_city_block": validators.address, "jp_person_name_keyword": validators.person_name, "jp_mynumber_len12": validators.mynumber, "jp_phone_mobile": validators.mobile}
_NARROW = str.maketrans(scalars.WIDE, scalars.NARROW)
_WIDE_CODES = np.array(sorted(map(ord, scalars.WIDE)))
#: Letters beyond ASCII that fold to an ASCII letter where case doesn't count.
_FOLDED = ("ſ".encode(), "K".encode())
_KIND_TABLE = np.zeros((len(patterns.KINDS), 256), bool)
for _k, _kind in enumerate(patterns.KINDS):
    _KIND_TABLE[_k, 128:] = _kind is None
    if _kind:
        _KIND_TABLE[_k, [ord(c) for c in _kind]] = True

FOUND = "array<struct<rule:int,start:int,stop:int,byte_start:bigint,byte_end:bigint,utf16_start:bigint,utf16_end:bigint,hit:string>>"


class Finder:
    """A rule's matches in a line, leftmost first and without overlap, in characters.

    A pattern that begins with a run up to a sign (as addresses do) is looked for at its signs, so a long run without one costs nothing.
    """

    def __init__(self, pattern: str) -> None:
        import regex

        self.run = run = patterns.leading_run(pattern)
        if not run:
            self.whole = regex.compile(patterns.python_pattern(pattern))
        else:
            flag = "(?i)" if run.fold else ""
            one = regex.compile(flag + run.members)
            self.members = {c for c in map(chr, (*range(128), 0x17F, 0x212A)) if one.fullmatch(c)}
            self.rest, self.edge = regex.compile(flag + patterns.python_pattern(run.rest)), regex.compile(r"\b")

    def __call__(self, line: str) -> Iterator[tuple[int, int]]:
        if not self.run:
            for m in self.whole.finditer(line):
                yield m.span()
            return
        done, sign = 0, -1
        while (sign := line.find(self.run.sign, max(done, sign + 1))) >= 0:
            m = self.rest.match(line, sign + 1)
            if not m:
                continue
            start = sign
            while start > done and line[start - 1] in self.members:
                start -= 1
            while self.run.edge and start < sign and not self.edge.match(line, start):
                start += 1
            if start < sign:
                yield start, m.end()
                done = m.end()


@dataclass
class Line:
    row: int
    number: int  # from 0
    start: int  # bytes in the buffer
    stop: int
    text: str
    spans: list[tuple[int, int, int]]  # start, stop, rule


def _suppressed(rule: Rule, line: str, start: int, stop: int) -> bool:
    """As detect.suppressed: whether what surrounds a match shows that it is something else."""
    if rule.id == "pii.jp.mynumber.unlabeled":
        near = line[max(0, start - 24) : stop + 16]
        low = near.lower()
        return any(w in near for w in ("注文番号", "受付番号", "伝票番号")) or any(w in low for w in ("order", "receipt", "ticket"))
    if rule.id == "pii.jp.postal_code":
        at = start
        while at and (line[at - 1].isspace() or line[at - 1] in ":=-：＝"):
            at -= 1
        head = line[max(0, at - 16) : at]
        if head.endswith("バージョン"):
            return True
        for word in ("version", "build", "release", "rev", "commit"):
            if head.lower().endswith(word):
                before = at - len(word) - 1
                return before < 0 or not (line[before].isascii() and (line[before].isalnum() or line[before] == "_"))
    return False


class Scanner:
    def __init__(self, rules: list[Rule], marker: str, narrow: bool = True, markers: bool = True, split: bool = True) -> None:
        self.rules = [(k, r) for k, r in enumerate(rules) if r.enabled]
        self.marker, self.markers, self.split = marker, markers, split
        self.wide = np.array([narrow and r.normalises for _, r in self.rules], bool)
        self.needs = [patterns.needs(r.pattern) for _, r in self.rules]
        self.counts = np.array([n.counts for n in self.needs], np.int64).reshape(len(self.rules), len(patterns.KINDS))
        self.words: dict[tuple[bytes, bool], list[int]] = {}
        for k, n in enumerate(self.needs):
            for text, exact in n.words:
                self.words.setdefault((text.encode(), exact), []).append(k)
        self.free = np.array([not n.words for n in self.needs], bool)
        self.folds = [k for k, n in enumerate(self.needs) if any(not exact for _, exact in n.words)]
        self.finders: dict[int, Finder] = {}  # compiled when a line first needs them

    def _wanted(self, raw: bytes, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """(lines, rules): whether a line holds what a rule needs."""
        out = np.ones((len(starts), len(self.rules)), bool)
        if not len(starts):
            return out
        for k in np.flatnonzero(self.counts.any(axis=0)).tolist():
            sums = np.concatenate([[0], np.cumsum(_KIND_TABLE[k][data], dtype=np.int32)])
            out &= (sums[stops] - sums[starts])[:, None] >= self.counts[None, :, k]
        held = np.repeat(self.free[None], len(starts), axis=0)
        there = out.any(axis=0)
        low = raw.lower() if any(there[k] for k in self.folds) else b""
        for (word, exact), own in self.words.items():
            if not there[own].any():
                continue
            text, at = raw if exact else low, 0
            hits = []
            while (at := text.find(word, at)) >= 0:
                k = int(np.searchsorted(starts, at, "right")) - 1
                hits.append(k)
                at = max(int(stops[k]), at + 1)  # once a line is enough
            if hits:
                held[np.ix_(hits, own)] = True
        for letter in _FOLDED if low else ():
            at = 0
            while (at := raw.find(letter, at)) >= 0:
                held[int(np.searchsorted(starts, at, "right")) - 1, self.folds] = True
                at += 1
        return out & held

    def lines(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of the lines of rows, and where each row's lines begin (rows + 1).  \\n or \\r\\n ends a line, and an end behind the last one makes no empty line."""
        if not self.split:
            return offs[:-1].copy(), offs[1:].copy(), np.arange(len(offs))
        ends = np.flatnonzero(data == 10)
        last = offs[1:][np.diff(offs) > 0]
        open_end = last[data[last - 1] != 10]  # a last line without an end
        stops, closed = np.concatenate([open_end, ends]), np.repeat([False, True], [len(open_end), len(ends)])
        order = np.argsort(stops, kind="stable")  # an open end comes before the next row's first byte
        stops, closed = stops[order], closed[order]
        starts = np.empty(len(stops), np.int64)
        if len(stops):
            starts[0] = 0
            starts[1:] = stops[:-1] + closed[:-1]
        rows = np.searchsorted(starts, offs)
        cut = closed & (stops > starts) & (data[np.maximum(stops - 1, 0)] == 13)
        return starts, stops - cut, rows

    def scan(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[Line], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The lines with matches, and the bounds of all."""
        starts, stops, rows = self.lines(data, offs)
        raw = data.tobytes()
        wanted = self._wanted(raw, data, starts, stops)
        narrowed: dict[int, tuple[str, np.ndarray]] = {}
        if self.wide.any():
            lead = np.flatnonzero((data == 0xE2) | (data == 0xE3) | (data == 0xEF))
            lead = lead[lead + 2 < len(data)]
            codes = (data[lead].astype(np.int64) & 15) << 12 | (data[lead + 1].astype(np.int64) & 63) << 6 | (data[lead + 2] & 63)
            some = np.unique(np.searchsorted(starts, lead[np.isin(codes, _WIDE_CODES)], "right") - 1)
            if len(some):
                texts = [raw[starts[k] : stops[k]].decode("utf-8").translate(_NARROW) for k in some.tolist()]
                parts = [t.encode() for t in texts]
                ends = np.cumsum([len(p) for p in parts])
                joined = b"".join(parts)
                more = self._wanted(joined, np.frombuffer(joined, np.uint8), ends - [len(p) for p in parts], ends) & self.wide[None]
                narrowed = {int(k): (t, w) for k, t, w in zip(some, texts, more)}
                for k, (_, w) in narrowed.items():
                    wanted[k] |= w  # so that the line is looked at; the line's own pattern decides
        out = []
        row_of = np.searchsorted(rows, np.arange(len(starts)), "right") - 1
        for k in np.flatnonzero(wanted.any(axis=1)).tolist():
            line = raw[starts[k] : stops[k]].decode("utf-8")
            spans = self._spans(line, np.flatnonzero(wanted[k]).tolist(), narrowed.get(k))
            if spans:
                row = int(row_of[k])
                out.append(Line(row, k - int(rows[row]), int(starts[k]), int(stops[k]), line, spans))
        return out, (starts, stops, rows)

    def _spans(self, line: str, chosen: list[int], narrowed: tuple[str, np.ndarray] | None) -> list[tuple[int, int, int]]:
        marked = self.markers and self.marker in line
        if marked and (f"# {self.marker}" in line or f"// {self.marker}" in line) and f"{self.marker}=" not in line:
            return []
        out = []
        for k in chosen:
            number, rule = self.rules[k]
            if marked and f"{self.marker}={rule.id}" in line:
                continue
            if k not in self.finders:
                self.finders[k] = Finder(rule.pattern)
            check = _CHECKS.get(rule.validator)
            seen = set()
            for text in (line,) if narrowed is None or not self.wide[k] else (line, narrowed[0]):
                for start, stop in self.finders[k](text):
                    if (start, stop) in seen or _suppressed(rule, line, start, stop) or check and not check(text[start:stop]):
                        continue
                    seen.add((start, stop))
                    out.append((start, stop, number))
        return out


_scanners: dict[tuple, Scanner] = {}


def _scanner(rules: list[Rule], marker: str, **options) -> Scanner:
    """One a worker for the same rules, as compiling patterns takes longer than many a batch."""
    key = (tuple(rules), marker, tuple(sorted(options.items())))
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(rules, marker, **options)
    return _scanners[key]


def places(line: str, spans: list[tuple[int, int, int]]) -> tuple[dict[int, int], dict[int, int]]:
    """The bytes and the UTF-16 units before each place of a line, in one walk."""
    edges = sorted({p for s in spans for p in s[:2]})
    if line.isascii():
        same = {p: p for p in edges}
        return same, same
    octets, units, at, b, u = {}, {}, 0, 0, 0
    for p in edges:
        part = line[at:p]
        b += len(part.encode())
        u += len(part.encode("utf-16-le")) // 2
        octets[p], units[p], at = b, u, p
    return octets, units


def islands(spans: list[tuple[int, int, int]]) -> list[list]:
    """[start, stop, [spans]] merged where spans overlap or touch."""
    out: list[list] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
            out[-1][2].append(s)
        else:
            out.append([s[0], s[1], [s]])
    return out


def masked(line: str, spans: list[tuple[int, int, int]], hide: Callable[[str, list], str]) -> str:
    parts, at = [], 0
    for start, stop, own in islands(spans):
        parts += [line[at:start], hide(line[start:stop], own)]
        at = stop
    return "".join([*parts, line[at:]])


def hiding(mode: str, placeholder: str) -> Callable[[str, list], str]:
    """redact puts the placeholder, partial keeps the last four characters of more than four, plain keeps all."""
    if mode == "plain":
        return lambda text, _: text
    return (lambda *_: placeholder) if mode == "redact" else lambda text, _: "****" if len(text) <= 4 else "****" + text[-4:]


def _chunks(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of a string column, null as empty, CHUNK_BYTES at a time."""
    column = batch.column(at)
    if not len(column):
        return
    column = column.cast(pa.large_string())
    if column.null_count:  # this copies the texts
        column = column.fill_null("")
    _, offsets, content = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK_BYTES, "right")) - 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def scan_lines(docs: DataFrame, rules: list[Rule], marker: str, text_col: str = "text", context: int = 5, mode: str = "redact", placeholder: str = "<REDACTED>", **options) -> DataFrame:
    """A row for each line with matches: the other columns, line_number (from 1), line, context_before, masked_snippet, and found, an array of all its matches.

    A null or empty text has no lines; repeated rows count each; an empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c != text_col]
    own = docs.select(*rest, text_col).schema
    schema = T.StructType([*(f for f in own.fields if f.name != text_col), *T._parse_datatype_string(f"line_number long, line string, context_before array<string>, masked_snippet string, found {FOUND}").fields])
    hide, wide = hiding(mode, placeholder), max((r.context_lines_before for r in rules), default=0)
    context = min(context, wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        scanner, arrow = _scanner(rules, marker, **options), None
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            arrow = arrow or pa.schema([*(batch.schema.field(c) for c in rest), *list(to_arrow_schema(schema))[len(rest) :]])
            for lo, _, data, offs in _chunks(batch, at):
                lines, (starts, stops, firsts) = scanner.scan(data, offs)
                if not lines:
                    continue
                before, found = [], []
                for one in lines:
                    k = int(firsts[one.row]) + one.number
                    low = max(int(firsts[one.row]), k - context)
                    before.append([data[starts[i] : stops[i]].tobytes().decode("utf-8") for i in range(low, k)])
                    octets, units = places(one.text, one.spans)
                    found.append([(r, s, e, octets[s], octets[e], units[s], units[e], one.text[s:e]) for s, e, r in one.spans])
                names = ("rule", "start", "stop", "byte_start", "byte_end", "utf16_start", "utf16_end", "hit")
                flat = list(zip(*(m for row in found for m in row)))
                kinds = (*(pa.int32(),) * 3, *(pa.int64(),) * 4, pa.string())
                inner = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(flat, kinds)], list(names))
                edges = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32())
                columns = [batch.column(batch.schema.get_field_index(c)).take(pa.array([lo + x.row for x in lines])) for c in rest]
                columns += [pa.array([x.number + 1 for x in lines], pa.int64()), pa.array([x.text for x in lines], pa.string()), pa.array(before, pa.list_(pa.string())), pa.array([masked(x.text, x.spans, hide) for x in lines], pa.string()), pa.ListArray.from_arrays(edges, inner)]
                yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    return docs.select(*rest, text_col).mapInArrow(run, schema)


def rewrite(docs: DataFrame, rules: list[Rule], marker: str, text_col: str, hide: Callable[[str, list], str], joined: str | None = "\n", **options) -> DataFrame:
    """All rows, with their text's lines masked; joined: what stands between lines afterwards (an end behind the last goes), None: the value is one line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules, marker, split=joined is not None, **options)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo, hi, data, offs in _chunks(batch, at):
                lines, (starts, stops, firsts) = scanner.scan(data, offs)
                fresh = {int(firsts[x.row]) + x.number: masked(x.text, x.spans, hide) for x in lines}
                raw, changed = data.tobytes(), {x.row for x in lines}
                texts: list[str | None] = []
                for row in range(len(offs) - 1):
                    if row not in changed and (joined is None or joined == "\n" and b"\r\n" not in raw[offs[row] : offs[row + 1]]):
                        text = raw[offs[row] : offs[row + 1]].decode("utf-8")
                        texts.append(text[:-1] if joined and text.endswith("\n") else text)
                        continue
                    own = range(int(firsts[row]), int(firsts[row + 1]))
                    texts.append((joined or "").join(fresh[k] if k in fresh else raw[starts[k] : stops[k]].decode("utf-8") for k in own))
                part = batch.slice(lo, hi - lo)  # a chunk goes out when it is done, so a worker holds no batch's texts
                missing = part.column(at).is_null().to_numpy(zero_copy_only=False)
                column = pa.array([None if gone else t for t, gone in zip(texts, missing)], batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([column if k == at else c for k, c in enumerate(part.columns)], schema=batch.schema)

    if joined is not None:
        small_batches(docs.sparkSession)  # whole texts, not lines
    return docs.mapInArrow(run, docs.schema)
