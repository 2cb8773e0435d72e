"""Normalisation by a compiled character map, with each normalised byte's place in the source.

The map is a double-array trie over UTF-8 prefixes with their replacements.  Text is read from left to right: at each place the longest prefix that the map has is
replaced, else one character stays.  All places where a prefix can begin walk the trie together, a byte a step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLANK = np.array([0xE2, 0x96, 0x81], np.uint8)  # U+2581, which stands for a blank


@dataclass(frozen=True)
class Rules:
    """How a model normalises."""

    charmap: bytes = b""
    dummy_prefix: bool = True
    extra_spaces: bool = False  # whether runs of blanks shrink to one and those at the ends go
    escape: bool = True  # whether a blank becomes U+2581


class CharMap:
    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.values = np.frombuffer(blob[4 + size :], np.uint8)
        ends = np.flatnonzero(self.values == 0)
        self.end_of = np.zeros(len(self.values) + 1, np.int64)  # the end of the replacement that begins at each place
        if len(ends):
            self.end_of[: ends[-1] + 1] = ends[np.searchsorted(ends, np.arange(ends[-1] + 1))]
        first = np.arange(256)
        self.begins = np.zeros(256, bool)
        if len(self.units):
            root = self._offset(self.units[:1])[0]
            node = root ^ first
            there = node < len(self.units)
            self.begins[there] = (self.units[node[there]] & 0x800000FF) == first[there]

    @staticmethod
    def _offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: np.ndarray, at: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the length of the longest prefix in the map that ends before its limit (0: none), and where its replacement begins."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        alive = np.arange(len(at))
        node = np.full(len(at), self._offset(self.units[:1])[0] if len(self.units) else 0, np.int64)
        step = 0
        while len(alive):
            alive = alive[at[alive] + step < limit[alive]]
            byte = data[at[alive] + step].astype(np.int64)
            now = node[alive] ^ byte
            fits = now < len(self.units)
            fits[fits] = (self.units[now[fits]] & 0x800000FF) == byte[fits]
            alive, now = alive[fits], now[fits]
            unit = self.units[now]
            node[alive] = now ^ self._offset(unit)
            leaf = alive[(unit >> 8) & 1 == 1]
            step += 1
            length[leaf] = step
            value[leaf] = self.units[node[leaf]] & 0x7FFFFFFF
        return length, value


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _replaced(table: CharMap, data: np.ndarray, offs: np.ndarray):
    """The bytes after the map, their places in the source (from the row's start), and the rows' new offsets."""
    row_of = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    origin = np.arange(len(data)) - offs[row_of]
    at = np.flatnonzero(table.begins[data] & ((data & 0xC0) != 0x80))
    if len(at):
        length, value = table.longest(data, at, offs[row_of[at] + 1])
        at, length, value = at[length > 0], length[length > 0], value[length > 0]
        taken = np.ones(len(at), bool)
        if len(at) > 1 and (at[1:] < at[:-1] + length[:-1]).any():  # prefixes that overlap: the one on the left wins
            end = -1
            for i, (a, n) in enumerate(zip(at.tolist(), length.tolist())):
                taken[i] = a >= end
                end = a + n if taken[i] else end
        at, length, value = at[taken], length[taken], value[taken]
    if not len(at):
        start = np.flatnonzero((data & 0xC0) != 0x80)  # a character's bytes all come from its start
        return data, origin[start[np.cumsum((data & 0xC0) != 0x80) - 1]] if len(data) else origin, offs
    # units of the source: the replaced prefixes, and all other characters
    covered = np.zeros(len(data) + 1, np.int32)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + length, -1)
    begin = ((data & 0xC0) != 0x80) & (np.cumsum(covered[:-1]) == 0)
    begin[at] = True
    unit = np.flatnonzero(begin)
    pool = np.concatenate([data, table.values])
    source, size = unit.copy(), np.diff(np.append(unit, len(data)))
    where = np.searchsorted(unit, at)
    source[where], size[where] = len(data) + value, table.end_of[value] - value
    fresh = np.concatenate([[0], np.cumsum(size)])
    return pool[_ranges(source, size)], np.repeat(origin[unit], size), fresh[np.searchsorted(unit, offs)]


def normalise(rules: Rules, table: CharMap, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of UTF-8 (bytes, offsets): their normalised bytes, the offsets of these, and each byte's place in its source row.

    The places have one entry more a row, the row's end, so byte p of row r has entry p + r.
    """
    rows = len(offs) - 1
    out, origin, fresh = _replaced(table, data, offs)
    row_of = np.repeat(np.arange(rows), np.diff(fresh))
    final = np.diff(offs).astype(np.int64)  # where each row's last byte ends in the source
    lead = np.zeros(rows, np.int64)  # where its dummy prefix stands there
    if rules.extra_spaces:
        blank = out == 0x20
        last = np.maximum.accumulate(np.where(blank, -1, np.arange(len(out)))) if len(out) else np.zeros(0, np.int64)
        inside = last >= fresh[row_of]  # something that isn't blank stands before, in its row
        after = np.flip(np.minimum.accumulate(np.flip(np.where(blank, len(out), np.arange(len(out)))))) if len(out) else np.zeros(0, np.int64)
        more = after < fresh[row_of + 1]
        keep = ~blank | (inside & more & np.append(False, ~blank[:-1])) if len(out) else blank
        for r in np.flatnonzero(np.diff(fresh)).tolist():
            a, b = int(fresh[r]), int(fresh[r + 1])
            own = np.flatnonzero(~blank[a:b])
            if len(own):
                lead[r] = origin[a + own[0]]
            stop, whole = b, out[a:b].tobytes()
            while stop > a and (blank[stop - 1] or rules.escape and whole[: stop - a].endswith(b"\xe2\x96\x81")):
                stop -= 1 if blank[stop - 1] else 3  # a written U+2581 at the end counts as a blank
            if stop < b:
                final[r], keep[stop:b] = origin[stop], False
        out, origin, row_of = out[keep], origin[keep], row_of[keep]
        fresh = np.concatenate([[0], np.cumsum(np.bincount(row_of, minlength=rows))]).astype(np.int64)
    size = np.where(out == 0x20, 3, 1) if rules.escape else np.ones(len(out), np.int64)
    filled = np.flatnonzero(np.diff(fresh))  # an empty row stays empty
    prefix = np.zeros(rows, np.int64)
    if rules.dummy_prefix:
        prefix[filled] = 3 if rules.escape else 1
    lengths = np.bincount(row_of, size, rows).astype(np.int64) + prefix
    ends = np.concatenate([[0], np.cumsum(lengths)])
    # each row: its prefix, its bytes, and one entry more for the places
    at = np.cumsum(size) - size + np.cumsum(prefix)[row_of] if len(out) else np.zeros(0, np.int64)
    made, places = np.zeros(int(ends[-1]), np.uint8), np.zeros(int(ends[-1]) + rows, np.int64)
    mark = BLANK if rules.escape else np.array([0x20], np.uint8)
    for k in range(len(mark)):
        some = ends[filled][prefix[filled] > 0] + k
        made[some] = mark[k]
        places[some + filled[prefix[filled] > 0]] = lead[filled][prefix[filled] > 0]
    plain = size == 1
    made[at[plain]] = out[plain]
    places[at[plain] + row_of[plain]] = origin[plain]
    for k in range(3 if rules.escape else 0):
        made[at[~plain] + k] = BLANK[k]
        places[at[~plain] + k + row_of[~plain]] = origin[~plain]
    places[ends[1:] + np.arange(rows)] = final
    return made, ends, places
