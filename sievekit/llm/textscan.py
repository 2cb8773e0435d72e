"""Vectorised scanning of text columns: word bounds, word hashes, pre-token bounds.

An Arrow string column already is one UTF-8 buffer with offsets.  Everything here works on that
buffer with numpy, a bounded slice of rows at a time, so no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Bytes of text that are scanned at once; a longer single text is scanned whole.
CHUNK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words up to so many bytes are hashed eight bytes at a time, all together; longer ones one by one.
_SHORT = 64
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number each."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range's bytes and length.

    No step is a sum or a polynomial, so no arrangement of letters makes two words collide whatever the seed; words may still
    collide by chance or by design, so whoever reuses a word's answer compares the bytes (`distinct`).
    """
    from xxhash import xxh3_64_intdigest

    eights, size = _eights(data), ends - starts
    out = mix(size.astype(np.uint64) + _STEP)
    some = np.flatnonzero(size)
    for at in range(0, _SHORT, 8):
        if at:
            some = some[size[some] > at]
        if not len(some):
            break
        part = eights[starts[some] + at] & _MASKS[np.minimum(size[some] - at, 8)]
        out[some] = mix((out[some] ^ part) + _STEP)
    long = some[size[some] > _SHORT]
    if len(long):
        raw = data.tobytes()
        out[long] = [xxh3_64_intdigest(raw[s:e], 7) for s, e in zip(starts[long].tolist(), ends[long].tolist())]
    return out


def _equal(data: np.ndarray, starts: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether range a[i] has the same bytes as range b[i]."""
    eights = _eights(data)
    same = size[a] == size[b]
    rest = np.flatnonzero(same)
    for at in range(0, _SHORT, 8):
        rest = rest[size[a[rest]] > at]
        if not len(rest):
            break
        x, y = a[rest], b[rest]
        differ = ((eights[starts[x] + at] ^ eights[starts[y] + at]) & _MASKS[np.minimum(size[x] - at, 8)]) != 0
        same[rest[differ]] = False
        rest = rest[~differ]
    for i in rest[size[a[rest]] > _SHORT].tolist():
        x, y, n = int(starts[a[i]]), int(starts[b[i]]), int(size[a[i]])
        same[i] = bool((data[x + _SHORT : x + n] == data[y + _SHORT : y + n]).all())
    return same


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each range the number of its content, in the order of first places; each content's first range and hash.

    Equal numbers mean equal bytes: each range is compared with the first of its hash.
    """
    hashes = word_hashes(data, starts, ends)
    codes, _ = pd.factorize(hashes)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1)) if len(codes) else np.zeros(0, np.int64)
    again = np.ones(len(codes), bool)
    again[first] = False
    again = np.flatnonzero(again)
    other = again[~_equal(data, starts, ends - starts, again, first[codes[again]])]
    if len(other):  # words that share a hash and differ
        raw, known = data.tobytes(), {}
        codes = codes.copy()
        for i in other.tolist():
            codes[i] = known.setdefault(raw[starts[i] : ends[i]], len(first) + len(known))
        codes, _ = pd.factorize(codes)
        first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
    return codes, first, hashes[first]


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each range of a sequence of numbers; ranges may overlap.

    Sums of mixed powers of two lengths, as in a sparse table: the hash of 2**k numbers mixes those of its halves, and a
    range is its two covering runs of the largest such length.
    """
    size = ends - starts
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    level = np.frexp(np.maximum(size, 1))[1] - 1  # 2**level is the largest power up to size
    now = mix(values.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
    for k in range(int(level.max()) + 1):
        own = np.flatnonzero((level == k) & (size > 0))
        if len(own):
            out[own] = mix(mix(now[starts[own]] + size[own].astype(np.uint64)) ^ (now[ends[own] - (1 << k)] + _STEP))
        if len(now) <= 1 << k:
            break
        now = mix(mix(now[: -(1 << k)] + _STEP) ^ now[1 << k :])
    return out


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets from 0; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


_trim = None


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks, and many share an executor's memory."""
    global _trim
    if _trim is None:
        try:
            _trim = ctypes.CDLL(None).malloc_trim
        except (OSError, AttributeError):  # no such call here
            _trim = lambda _: 0
    pa.default_memory_pool().release_unused()
    _trim(0)


def row_chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, of one row at least."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi
    release()


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of words `[^\\x20\\x09-\\x0D]+`: starts, ends, and where each row's words begin (rows + 1)."""
    inside = ~_SEPARATOR[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    before[edges], after[edges - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one blank behind each, and where they stand there."""
    mask = np.zeros(len(data) + 1, np.int8)
    np.add.at(mask, starts, 1)
    np.add.at(mask, ends, -1)
    size = ends - starts
    to = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum() + len(size)), 0x20, np.uint8)
    inside = np.cumsum(mask[:-1]).astype(bool)
    blank = np.zeros(len(out), bool)
    blank[to + size] = True
    out[~blank] = data[inside]
    return out.tobytes(), to, to + size


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


# ---- Pre-tokens -----------------------------------------------------------------------------

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    """The class of every code point, as tiktoken's own pattern engine and Unicode version have it.

    A pattern of one class alone makes the library drop all other characters, so encoding every
    code point by single bytes lists the class.
    """
    global _classes
    if _classes is None:
        import tiktoken

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            one = tiktoken.Encoding(f"class{kind}", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            found = bytes(one.encode_ordinary(every)).decode("utf-8")
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
        _classes = table
    return _classes


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a UTF-8 buffer and the byte at which each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    if len(at) == len(data):
        return data.astype(np.uint32), at
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), at


def pretoken_starts(data: np.ndarray, offs: np.ndarray, joined_space: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds in bytes of the pre-tokens of a contraction / letters / numbers / others / white space pattern.

    joined_space: the pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``;
    else it is ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+`` and white space is dropped.
    Returns starts, ends, and where each row's pre-tokens begin (rows + 1).
    """
    points, at = code_points(data)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind = _class_table()[points]
    rows = np.searchsorted(at, offs)  # the first code point of each row
    row_start = np.zeros(n + 1, bool)
    row_start[rows[rows < n]] = True
    row_start[n] = True
    first = np.empty(n + 1, bool)  # begins a run of one class
    first[0], first[n] = True, True
    first[1:n] = kind[1:] != kind[:-1]
    first |= row_start
    begin = first.copy()
    # Contractions: an apostrophe that begins a run of OTHER and has its letters right behind it.
    quote = np.flatnonzero((points == 39) & first[:n])
    if len(quote):
        if joined_space:
            quote = quote[~((quote > 0) & (points[quote - 1] == 32) & ~row_start[quote])]
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        limit = np.concatenate([row_start, np.ones(2, bool)])
        one, two = padded[quote + 1], padded[quote + 2]
        fits1 = ~limit[quote + 1]
        fits2 = fits1 & ~limit[np.minimum(quote + 2, n + 1)]
        single = fits1 & np.isin(one, [ord("s"), ord("t"), ord("m"), ord("d")])
        double = fits2 & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for chosen, size in ((quote[single], 2), (quote[double], 3)):
            begin[chosen + 1] = False  # the letters' run does not begin a token of its own
            begin[chosen + size] = True
    if joined_space:
        # The last blank of a run of white space goes to what follows; any other last character stands alone.
        last = np.flatnonzero((kind == SPACE) & first[1:] & ~row_start[1:])
        begin[last] = True
        blanks = last[points[last] == 32]
        begin[blanks + 1] = False
        starts = np.flatnonzero(begin[:n])
        ends = np.append(starts[1:], n)
    else:
        begin[:n] |= kind == NUMBER
        starts = np.flatnonzero(begin[:n])
        ends = np.append(starts[1:], n)
        kept = kind[starts] != SPACE
        starts, ends = starts[kept], ends[kept]
    to_byte = np.append(at, len(data))
    return to_byte[starts], to_byte[ends], np.searchsorted(starts, rows)
