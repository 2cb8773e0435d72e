"""Toxicity: a support vector machine over a gap-weighted subsequence kernel, with Nystroem landmarks.

The kernel of two words (Lodhi et al., 2002) sums over all subsequences of ORDER letters that they have in common, side by
side or not, each weighted by decay**gaps in either word; so inserted characters and gaps weaken a match and don't
break it.  A word is its letters between two boundaries; marks between two letters are one small gap, however many
they are.  A word of over FINE letters is also read in windows of so many, so an insult within other letters
isn't outweighed by them; one of over LONGEST letters is read in windows of either size alone, so a subsequence that
reaches over more than LONGEST letters (its weight would be under 0.06) doesn't count.  The machine learns from labelled texts, of which each is as toxic as its worst word.
It sees words through their kernel with the landmarks, and as it is linear there, the landmarks and their weights add
up to one weight for each subsequence, which is all that scoring needs.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm import textscan
from sievekit.llm.common import gather_ranges, small_batches, texts
from sievekit.llm.labelled import calibrate, fold, learn, sample, sigmoid

#: Symbols of a subsequence; decay for each letter that it leaves out, and the share of that for a mark.
ORDER, DECAY, MARK = 4, 0.9, 0.1
#: K(s, t) / (K(s, s) K(t, t)) ** (SHARP / 2): a kernel for any power; below 1, inserted letters cost less.
SHARP = 0.5
#: Symbols: the boundaries (0 and the last), and letters with the marks over them taken off; rare letters share some.
SYMBOLS = 48
#: Letters of the windows in which longer words are read, each half over the one before.
LONGEST = 32
#: Letters of the windows in which words are read beside the whole, and how far each is from the one before.
FINE, STEP = 12, 3
#: Words of toxic texts that the machine learns at most; words of clean texts among the landmarks.
WITNESSES, CLEAN_LANDMARKS = 128, 96
#: Values of words that a worker keeps.
CACHE_WORDS = 1_000_000
#: Labelled documents of each label that are learned from at most.
PER_LABEL = 1500

# Characters that stand for letters in disguised words.
_DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point its symbol in lower case, or 0 for a mere gap: a to z are 1 to 26, all other letters share the rest by their code."""
    global _table
    if _table is None:
        table = np.zeros(0x110000, np.uint8)
        every = np.flatnonzero(textscan._class_table() == textscan.LETTER)
        low = every.copy()
        small = every[every < 0x2C00]
        low[: len(small)] = [ord(chr(c).lower()[0]) for c in small.tolist()]
        table[every] = np.where((low >= 97) & (low <= 122), low - 96, 27 + low % (SYMBOLS - 28))
        for c, letter in _DISGUISE.items():
            table[ord(c)] = ord(letter) - 96
        _table = table
    return _table


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (0 is a gap) of a chunk, bounds of its words in them, and each row's first word.

    A run of words of one character each counts as one word, so spelled-out words are read as one.  Marks before and
    behind a word's letters don't belong to it, a word without letters is none, and a long one has windows.
    """
    points, at = textscan.code_points(data)
    starts, ends, rows = textscan.words(data, offs)
    place = np.searchsorted(at, np.concatenate([starts, ends]))
    first, last = place[: len(starts)], place[len(starts) :]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(rows))
    joint = np.zeros(len(first), bool)
    joint[1:] = (last[1:] - first[1:] == 1) & (last[:-1] - first[:-1] == 1) & (row[1:] == row[:-1])
    head = np.flatnonzero(~joint)
    if len(head):
        first, last, row = first[head], last[np.append(head[1:], len(first)) - 1], row[head]
    symbols = _letters()[points]
    # marks behind marks go: what is between two letters is one mark at most
    stays = symbols > 0
    stays[1:] |= symbols[:-1] > 0
    symbols, moved = symbols[stays], np.concatenate([[0], np.cumsum(stays)])
    first, last = moved[first], moved[last]
    seen = np.flatnonzero(symbols)
    a, b = np.searchsorted(seen, first), np.searchsorted(seen, last)
    full = b > a
    a, b, row = a[full], b[full], row[full]
    # bounds in letters: whole words or their windows, then the finer ones
    parts = []
    for size, step, some in ((LONGEST, LONGEST // 2, slice(None)), (FINE, STEP, np.flatnonzero(b - a > FINE))):
        begin, end = a[some], b[some]
        count = np.maximum(-(-(end - begin - size) // step), 0) + 1
        lo = np.repeat(begin, count) + step * gather_ranges(np.zeros(len(count), np.int64), count)
        parts.append((lo, np.minimum(lo + size, np.repeat(end, count)), np.repeat(row[some], count)))
    lo, hi, row = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(row, kind="stable")
    first, last, row = seen[lo[order]], seen[hi[order] - 1] + 1, row[order]
    return symbols, first, last, np.searchsorted(row, np.arange(len(offs)))


class Words:
    """Some words in groups of equal numbers of symbols: symbols with both boundaries, and the gaps before each."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.n = len(first)
        size = last - first
        place = gather_ranges(first, size)
        word = np.repeat(np.arange(self.n), size)
        real = np.flatnonzero(symbols[place])
        letter, owner = symbols[place][real], word[real]
        count = np.bincount(owner, minlength=self.n)
        # marks between a letter and the one before it
        gap = np.diff(place[real], prepend=-1) - 1
        begin = np.cumsum(count) - count
        gap[begin[count > 0]] = 0
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []
        marked = np.bincount(owner, gap, self.n) > 0
        for key in np.unique(2 * count + marked).tolist():
            some = np.flatnonzero((count == key // 2) & (marked == key % 2))
            m = key // 2
            at = begin[some][:, None] + np.arange(m)[None, :]
            grid = np.full((len(some), m + 2), SYMBOLS - 1, np.int32)
            grid[:, 0], grid[:, 1:-1] = 0, letter[at]
            gaps = None
            if key % 2:
                gaps = np.zeros((len(some), m + 2))
                gaps[:, 1:-1] = gap[at] * MARK
            self.groups.append((some, grid, gaps))


def words_of(keys: list[bytes]) -> Words:
    """Words given by their symbols."""
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    ends = np.cumsum(size)
    return Words(np.frombuffer(b"".join(keys), np.uint8), ends - size, ends)


def symbols_of(word: str) -> bytes:
    return _letters()[[ord(c) for c in word]].tobytes()


_choices: dict[int, tuple[np.ndarray, ...]] = {}


def _subsequences(n: int) -> tuple[np.ndarray, ...]:
    """All ORDER places of n as two pairs (numbers of pairs), the pairs, and the places of the first and the last."""
    if n not in _choices:
        pairs = np.array(list(itertools.combinations(range(n), 2)), np.int32).reshape(-1, 2)
        number = np.zeros((n, n), np.int32)
        number[pairs[:, 0], pairs[:, 1]] = np.arange(len(pairs))
        four = np.fromiter(itertools.chain.from_iterable(itertools.combinations(range(n), ORDER)), np.int32).reshape(-1, ORDER)
        _choices[n] = number[four[:, 0], four[:, 1]], number[four[:, 2], four[:, 3]], pairs, four[:, 0], four[:, 3]
    return _choices[n]


def _positions(grid: np.ndarray, gaps: np.ndarray | None) -> np.ndarray:
    """Where each symbol stands, in steps of a letter."""
    n = grid.shape[1]
    return np.arange(n, dtype=np.float64)[None, :] if gaps is None else np.arange(n) + np.cumsum(gaps, axis=1)


def _decays(where: np.ndarray) -> np.ndarray:
    """DECAY to the number of letters between two places, for places in order (the first index is the later one)."""
    return np.tril(DECAY ** np.maximum(where[..., :, None] - where[..., None, :] - 1, 0), -1).astype(np.float32)


def subsequences(grid: np.ndarray, gaps: np.ndarray | None, size: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Codes (in base `size`) and weights, words x subsequences, of all subsequences of words of one length, some words at a time."""
    n = grid.shape[1]
    if n < ORDER:
        return
    one, two, pairs, first, last = _subsequences(n)
    where = _positions(grid, gaps)
    step = max(1, (1 << 20) // len(one))
    for lo in range(0, len(grid), step):
        some = slice(lo, lo + step)
        pair = grid[some][:, pairs[:, 0]] * size + grid[some][:, pairs[:, 1]]
        code = np.take(pair, one, axis=1)
        code *= size**2
        code += np.take(pair, two, axis=1)
        at = where if gaps is None else where[some]
        yield some, code, DECAY ** (at[:, last] - at[:, first] - (ORDER - 1))


def self_kernel(grid: np.ndarray, gaps: np.ndarray | None) -> np.ndarray:
    """K(s, s) of words of one length, summed over pairs of places step by step.

    After each step a cell holds the weights of all common subsequences of so many symbols that end at its two places:
    ORDER - 1 times, what ends before both places is carried there, with its decay, by a product from either side.
    """
    n = grid.shape[1]
    out = np.zeros(len(grid))
    step = max(1, (1 << 18) // (n * n))
    for lo in range(0, len(grid), step):
        some = slice(lo, lo + step)
        equal = (grid[some][:, :, None] == grid[some][:, None, :]).astype(np.float32)
        decay = _decays(_positions(grid[some], None if gaps is None else gaps[some]))
        now = equal
        for _ in range(ORDER - 1):
            now = equal * np.matmul(np.matmul(decay, now), decay.transpose(0, 2, 1))
        out[some] = now.sum(axis=(1, 2), dtype=np.float64)
    return out


def values(words: Words, table: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Sum over each word's subsequences of decay times weight, over the word's norm to the power SHARP.

    small: a number below size for each symbol, the last for those of no landmark; table: weights by the numbers of ORDER symbols.
    """
    out = np.zeros(words.n)
    size = int(small.max()) + 1
    for some, grid, gaps in words.groups:
        if grid.shape[1] < ORDER:
            continue
        for part, code, decay in subsequences(small[grid], gaps, size):
            got = np.take(table, code)
            out[some[part]] = (got * decay).sum(axis=1) if gaps is not None else got @ decay[0].astype(table.dtype)
        out[some] /= self_kernel(grid, gaps) ** (SHARP / 2)
    return out


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """K of all words of one length with all words of another, none with marks: each step is two products of matrices."""
    n, m = a.shape[1], b.shape[1]
    out = np.empty((len(a), len(b)))
    one, two = (_decays(np.arange(k, dtype=np.float64)) for k in (n, m))
    step = max(1, (1 << 20) // (n * m * len(b)))
    for lo in range(0, len(a), step):
        equal = (a[lo : lo + step].T[:, :, None, None] == b[None, None]).astype(np.float32)  # n, words, others, m
        now = equal
        for _ in range(ORDER - 1):
            now = equal * ((one @ now.reshape(n, -1)).reshape(-1, m) @ two.T).reshape(equal.shape)
        out[lo : lo + step] = now.sum(axis=(0, 3))
    return out


def norms(words: Words) -> np.ndarray:
    """K of each word with itself to the power SHARP / 2; 1 for a word without a subsequence."""
    out = np.ones(words.n)
    for some, grid, gaps in words.groups:
        if grid.shape[1] >= ORDER:
            out[some] = self_kernel(grid, gaps) ** (SHARP / 2)
    return out


def kernel(words: Words, others: Words) -> np.ndarray:
    """The kernel of each word with each of the others; none has marks."""
    out = np.zeros((words.n, others.n))
    for own, grid, _ in words.groups:
        for other, marks, _ in others.groups:
            if min(grid.shape[1], marks.shape[1]) >= ORDER:
                out[np.ix_(own, other)] = _cross(grid, marks)
    return out / norms(words)[:, None] / norms(others)[None, :]


def collapsed(words: Words, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of subsequences and their weights: the sum of the words' own, each word times its amount."""
    codes, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
    norm = norms(words)
    for some, grid, gaps in words.groups:
        if grid.shape[1] < ORDER:
            continue
        for part, code, decay in subsequences(grid, gaps, SYMBOLS):
            codes.append(code.ravel().astype(np.int64))
            weights.append((decay * (amounts / norm)[some[part]][:, None]).ravel())
    keys, row = np.unique(np.concatenate(codes), return_inverse=True)
    return keys, np.bincount(row, np.concatenate(weights), len(keys))


class Known:
    """Values of words seen, by their symbols; forgotten all at once when there are too many."""

    def __init__(self) -> None:
        self.values: dict[bytes, float] = {}

    def get(self, keys: list[bytes], compute) -> np.ndarray:
        """The value of each key; compute(numbers of new keys) gives those that are new."""
        out = np.array([self.values.get(k, np.nan) for k in keys])
        new = np.flatnonzero(np.isnan(out))
        if len(new):
            out[new] = compute(new)
            if len(self.values) + len(new) > CACHE_WORDS:
                self.values.clear()
            self.values.update((keys[i], v) for i, v in zip(new.tolist(), out[new].tolist()))
        return out


@dataclass
class Model:
    """The weight of each subsequence that has one, the machine's offset, and the calibration of a text's worst word."""

    codes: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float
    intercept: float

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "ready"}  # each worker makes its own

    def _prepared(self) -> tuple[np.ndarray, np.ndarray, Known]:
        """The weights as a table over the symbols that they use, the numbers of these, and the values of words seen."""
        if "ready" not in self.__dict__:
            digits = [self.codes // SYMBOLS**k % SYMBOLS for k in range(ORDER - 1, -1, -1)]
            used = np.unique(np.concatenate(digits))
            small = np.full(SYMBOLS, len(used), np.int32)
            small[used] = np.arange(len(used))
            table = np.zeros((len(used) + 1) ** ORDER, np.float32)
            code = np.zeros(len(self.codes), np.int64)
            for d in digits:
                code = code * (len(used) + 1) + small[d]
            table[code] = self.weights
            self.ready = table, small, Known()
        return self.ready

    def decide(self, words: Words) -> np.ndarray:
        """The machine's value of each word."""
        table, small, _ = self._prepared()
        return values(words, table, small) + self.offset

    def worst(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The decision value of the worst word of each row; of a row without words, the value of nothing at all."""
        symbols, first, last, rows = _tokens(data, offs)
        out = np.full(len(offs) - 1, self.offset)
        if not len(first):
            return out
        codes, own, _ = textscan.distinct(symbols, first, last)
        raw = symbols.tobytes()
        keys = [raw[s:e] for s, e in zip(first[own].tolist(), last[own].tolist())]
        known = self._prepared()[2]
        value = known.get(keys, lambda new: self.decide(Words(symbols, first[own[new]], last[own[new]])))
        full = np.flatnonzero(np.diff(rows))
        out[full] = np.maximum.reduceat(value[codes], rows[:-1][full])
        return out

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.worst(data, offs) + self.intercept)


def _chunks(texts_: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offs = textscan.buffer_of(pa.array(texts_, pa.large_string()))
    for a, b in textscan.row_chunks(offs):
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def _bags(texts_: list[str]) -> tuple[list[bytes], list[np.ndarray]]:
    """All distinct words by their symbols, and the numbers of each text's distinct words."""
    known: dict[bytes, int] = {}
    bags = []
    for a, b, data, offs in _chunks(texts_):
        symbols, first, last, rows = _tokens(data, offs)
        codes, own, _ = textscan.distinct(symbols, first, last)
        raw = symbols.tobytes()
        number = np.array([known.setdefault(raw[s:e], len(known)) for s, e in zip(first[own].tolist(), last[own].tolist())], np.int64)
        bags += [np.unique(number[codes[rows[i] : rows[i + 1]]]) for i in range(b - a)]
    return list(known), bags


def _diverse(texts_: list[str]) -> list[int]:
    """Texts of which no earlier one is a near copy, by six minhashes of their runs of three words: copies would make any of their words look like evidence."""
    seen: set[tuple] = set()
    kept = []
    for a, b, data, offs in _chunks(texts_):
        starts, ends, rows = textscan.words(data, offs)
        hashes = textscan.word_hashes(data, starts, ends)
        at = np.arange(len(hashes))
        runs = textscan.sequence_hashes(hashes, at, np.minimum(at + 3, np.repeat(rows[1:], np.diff(rows))))
        for i in range(b - a):
            own = runs[rows[i] : rows[i + 1]]
            keys = {(k, int(textscan.mix(own ^ np.uint64(k * 0x9E37 + 1)).min())) for k in range(6)} if len(own) else {(-1, 0)}
            if len(keys & seen) < min(3, len(keys)):
                kept.append(a + i)
                seen |= keys
    return kept


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40, seed: int = 5) -> tuple[np.ndarray, float]:
    """A linear support vector machine by dual coordinate descent (Hsieh et al., 2008); the last column is the offset."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    square, alpha, w = (x * x).sum(axis=1), np.zeros(len(x)), np.zeros(x.shape[1])
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(x)).tolist():
            before = alpha[i]
            after = min(max(before - (y[i] * float(x[i] @ w) - 1) / square[i], 0.0), cost[i])
            if after != before:
                w += (after - before) * y[i] * x[i]
                alpha[i] = after
                moved = max(moved, abs(after - before))
        if moved < 1e-4:
            break
    return w[:-1], float(w[-1])



def _suspects(bags: list[np.ndarray], y: np.ndarray, words: int, most: int) -> list[int]:
    """Words whose presence tells toxic texts from clean ones, best first, by boosting over the labelled texts.

    Each round adds the word that lowers the loss most, and texts that it explains lose weight (Cohen and Singer, 1999).
    Words that chance alone could put into so many toxic texts (Chernoff's bound, over all words) are left out.
    """
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    word = np.concatenate(bags) if bags else np.zeros(0, np.int64)
    toxic = y > 0
    bad = toxic[owner]
    odds = toxic.mean()
    held, hits = np.bincount(word, minlength=words), np.bincount(word[bad], minlength=words)
    share = np.clip(hits / np.maximum(held, 1), 1e-9, 1 - 1e-9)
    chance = held * (share * np.log(share / odds) + (1 - share) * np.log((1 - share) / (1 - odds)))
    fits = (share > odds) & (chance > np.log(50 * words))
    weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    smooth = 0.25 / toxic.sum()
    order = np.argsort(word, kind="stable")
    edges = np.searchsorted(word[order], np.arange(words + 1))
    out: list[int] = []
    while len(out) < most:
        plus, minus = np.bincount(word[bad], weight[owner[bad]], words), np.bincount(word[~bad], weight[owner[~bad]], words)
        gain = np.where(fits, np.sqrt(plus) - np.sqrt(minus), -1)
        gain[out] = -1
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        out.append(best)
        held_by = owner[order[edges[best] : edges[best + 1]]]
        vote = 0.5 * np.log((plus[best] + smooth) / (minus[best] + smooth))
        weight[held_by] *= np.exp(np.where(toxic[held_by], -vote, vote))
    return out


def disguises(key: bytes, random: np.random.Generator) -> list[bytes]:
    """Forms of a word with letters doubled and letters put in: examples that come from the label's own."""

    def put(times: int) -> bytes:
        out = key
        for _ in range(times):
            at = int(random.integers(1, max(len(out), 2)))
            out = out[:at] + bytes([int(random.integers(1, 27))]) + out[at:]
        return out

    between = lambda: bytes(itertools.chain.from_iterable((c, int(random.integers(1, 27))) for c in key[:-1])) + key[-1:]
    return [bytes(c for c in key for _ in range(2)), put(1), put(1), put(2), put(2), put(2), between(), between()]


def train(sentences: list[str], y: np.ndarray, rounds: int = 2, negatives: int = 3000, seed: int = 11) -> Model:
    """Learn from labelled texts.

    Which word makes a toxic text toxic is not labelled (multiple instances; Andrews et al., 2003).  Boosting over the texts names
    suspects; then, round by round, each toxic text is an example by its worst word, with disguised forms of it as
    further examples, and each clean text by its worst words.  Of labelled texts that are near copies of each
    other one is learned from.
    """
    kept = _diverse(sentences)
    sentences, y = [sentences[i] for i in kept], y[kept]
    words, bags = _bags(sentences)
    if not (y > 0).any() or not (y == 0).any():
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0, -20.0 if not (y > 0).any() else 20.0)
    toxic, clean = [b for b, t in zip(bags, y) if t > 0], [b for b, t in zip(bags, y) if t == 0]
    random = np.random.default_rng(seed)
    suspects = _suspects(bags, y, len(words), WITNESSES)
    pool = np.unique(np.concatenate(clean))
    if not suspects:
        held = np.bincount(np.concatenate(toxic), minlength=len(words)).astype(float)
        held[pool] = 0
        suspects = np.argsort(-held, kind="stable")[:WITNESSES][: int((held > 0).sum())].tolist() or np.unique(np.concatenate(toxic))[:WITNESSES].tolist()
    common = pool[np.argsort(-np.bincount(np.concatenate(clean), minlength=len(words))[pool], kind="stable")]
    negative = np.unique(np.concatenate([common[: negatives // 4], random.choice(pool, min(negatives // 4, len(pool)), replace=False)]))
    held = np.bincount(np.concatenate(toxic), minlength=len(words))
    named = {w: int(held[w]) for w in suspects}
    bare = [b for b in toxic if len(b) and not named.keys() & set(b.tolist())]  # toxic texts without a suspect
    found: Counter = Counter()
    extra: list[int] = []
    plain = lambda key: key.replace(b"\0", b"")  # noqa: E731  # without marks
    everything = words_of([words[i] for i in pool])
    for turn in range(rounds):
        counts = named | found
        bare_words = [plain(words[w]) for w in counts]
        marked = [disguises(w, random) for w in bare_words]
        plus = [*bare_words, *itertools.chain.from_iterable(marked)]
        own = np.array(list(counts.values()), np.float64) ** 0.5
        weight = np.concatenate([own, np.repeat(own / 4, [len(m) for m in marked])])
        minus = [plain(words[i]) for i in negative.tolist()]
        some = [*dict.fromkeys([*plus, *(plain(words[i]) for i in [*extra, *common[: CLEAN_LANDMARKS // 2].tolist()])])]
        marks = words_of(some)
        gram = kernel(marks, marks)
        eigen, vectors = np.linalg.eigh((gram + gram.T) / 2)
        keep = eigen > 1e-6 * eigen[-1]
        half = vectors[:, keep] / np.sqrt(eigen[keep])  # landmark kernels times this are the Nystroem features
        x = kernel(words_of([*plus, *minus]), marks) @ half
        label = np.concatenate([np.ones(len(plus)), -np.ones(len(minus))])
        cost = np.concatenate([weight * len(minus) / weight.sum(), np.ones(len(minus))])
        w, offset = _svm(x, label, 10 * cost)
        model = Model(*collapsed(marks, half @ w), offset, 1.0, 0.0)
        if turn + 1 < rounds:
            value = np.full(len(words), -np.inf)
            value[pool] = model.decide(everything)
            hard = pool[np.argsort(-value[pool], kind="stable")[: negatives // 2]]
            hard = np.unique(np.concatenate([hard, [int(b[value[b].argmax()]) for b in clean if len(b)]]))
            negative = np.unique(np.concatenate([negative, hard[value[hard] > -1.2]]))
            extra = [*extra, *[i for i in hard[np.argsort(-value[hard], kind="stable")].tolist() if i not in extra][:CLEAN_LANDMARKS]]
            found = Counter()
            for b in bare:  # their worst word, if the machine takes it for one
                got = model.decide(words_of([words[i] for i in b.tolist()]))
                if got.max() > 0 and value[b[got.argmax()]] == -np.inf:
                    found[int(b[got.argmax()])] += 1
    raw = np.concatenate([model.worst(data, offs) for _, _, data, offs in _chunks(sentences)])
    model.slope, model.intercept = calibrate(raw, y)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score from 0 to 1 (higher: more likely toxic) for each row; a null text counts as empty.

    Repeated rows and null ids are kept, ties can't arise, other columns are ignored, an empty table gives an empty table.
    Whole texts are read, whatever their length.  The model has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textscan.buffer_of(batch.column(1))
            for lo, hi in textscan.row_chunks(offs):
                value = shared.value.score(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(value, pa.float64())], names=["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below `threshold`: a narrow filter, so nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textscan.buffer_of(batch.column(batch.schema.get_field_index(text_col)))
            parts = [shared.value.score(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in textscan.row_chunks(offs)]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) < threshold))

    return docs.mapInArrow(run, docs.schema)


def fit(documents: DataFrame, labels: DataFrame, folds: int = 5, per_label: int = PER_LABEL) -> Model:
    """The model of the labelled documents outside fold 0, of at most `per_label` of either label; one task learns it."""
    return learn(sample(documents, labels, "toxic", folds, per_label), train)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 5) -> DataFrame:
    out = score(documents, fit(documents, labels, folds))
    return out.select("doc_id", F.coalesce(fold("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
