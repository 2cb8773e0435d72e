"""A causal self-attention language model over subword ids, in numpy.

One layer, one head.  The model predicts the class of the next id from a window of ids, and an id within its class by counts
from the whole corpus.  Classes hold either ids that begin a word or ids that go on with one, so the
probability that a word ends is a sum over classes, and words have proper probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Ids of a window, those of its start that are context only (but in a text's first window), width of the model.
WINDOW, CONTEXT, WIDTH = 24, 6, 16
#: Classes of ids that begin a word (the last is the end's own), and of others; ids with an embedding of their own.
STARTS, OTHERS, SLOTS = 24, 24, 1024
#: Ids whose counts as neighbours tell ids apart.
NEIGHBOURS = 160
CLASSES = STARTS + OTHERS
#: Weight of an id's share of its class against the counts behind one slot.
PRIOR = 10.0

_NAMES = ("embed", "query", "key", "value", "at_query", "at_key", "out", "bias")


@dataclass
class Model:
    """slot: an input row for each id; group: a class for each id; the last id is the text's end."""

    slot: np.ndarray
    group: np.ndarray
    within: np.ndarray  # an id's share of its class
    pairs: np.ndarray | None = None  # counts of an id's slot behind another's in one word
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        # how often a slot is followed in its word by any id of a class
        self.follow = None if self.pairs is None else np.stack([np.bincount(self._class_of_slot(), row, CLASSES) for row in self.pairs]).astype(np.float32)

    def _class_of_slot(self) -> np.ndarray:
        out = np.zeros(SLOTS, np.int64)
        own = np.flatnonzero(self.slot < SLOTS)
        out[self.slot[own]] = self.group[own]
        return out

    def share(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """An id's share of its class behind the slot before it; where the counts say little, its share anywhere."""
        out = self.within[ids]
        if self.pairs is None:
            return out
        fits = np.flatnonzero((before < SLOTS) & (self.group[ids] >= STARTS))
        ids, p = ids[fits], before[fits]
        own = self.slot[ids]
        seen = np.where(own < SLOTS, self.pairs[p, np.minimum(own, SLOTS - 1)], 0)
        out[fits] = (seen + PRIOR * out[fits]) / (self.follow[p, self.group[ids]] + PRIOR)
        return out

    @property
    def end(self) -> int:
        return len(self.slot) - 1


def start_weights(slots: int, seed: int = 1) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    shapes = {"embed": (slots, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH), "at_query": (WINDOW, WIDTH), "at_key": (WINDOW, WIDTH), "out": (WIDTH, CLASSES), "bias": (CLASSES,)}
    scale = {"embed": 0.5, "bias": 0.0, "at_query": 0.1, "at_key": 0.1}
    return {k: (r.standard_normal(s) * scale.get(k, 0.25)).astype(np.float32) for k, s in shapes.items()}


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in _NAMES])


def unflat(values: np.ndarray, slots: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, like in start_weights(slots).items():
        out[k] = values[at : at + like.size].reshape(like.shape).astype(np.float32)
        at += like.size
    return out


_CAUSAL = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_LIMIT = 20.0


_ONES = np.ones((max(WINDOW, CLASSES), 1), np.float32)
_SCALE = np.float32(WIDTH**-0.5)
#: Windows that are computed together, whatever the batch: their arrays then stay in a core's cache.
TOGETHER = 64
#: Places of a slot's weights among all of `embed`.
_CELLS = np.arange((SLOTS + 2) * WIDTH).reshape(-1, WIDTH)


def _gradients(w: dict[str, np.ndarray], three: np.ndarray, table: np.ndarray, at_place: np.ndarray, slots: np.ndarray, classes: np.ndarray, share: np.ndarray) -> tuple:
    """Of some windows: their part of the loss, and gradients for out, bias, at_place, three and each place's input row.

    three, table, at_place: query, key and value side by side, what they give for each slot, and what is added by place.  share: each place's part of the mean.
    Sums over short rows are products with ones, and what queries, keys and values share is one product.
    """
    many, n = slots.shape[0], slots.size
    x = np.take(w["embed"], slots.ravel(), axis=0)
    each = np.take(table, slots, axis=0)
    each += at_place
    q, k, v = each[:, :, :WIDTH], each[:, :, WIDTH : 2 * WIDTH], each[:, :, 2 * WIDTH :]
    a = np.matmul(q, k.transpose(0, 2, 1))
    np.clip(a, -_LIMIT, _LIMIT, out=a)
    np.exp(a, out=a)
    a *= _CAUSAL
    a /= a @ _ONES[:WINDOW]
    mixed = np.matmul(a, v)
    h = x + mixed.reshape(-1, WIDTH)
    z = h @ w["out"]
    z += w["bias"]
    np.clip(z, -60, 60, out=z)
    np.exp(z, out=z)
    total = z @ _ONES[:CLASSES, 0]
    at = np.arange(n) * CLASSES + classes.ravel()
    loss = -float(np.log(np.take(z, at) / total + 1e-12) @ share)
    z *= (share / total)[:, None]
    z.ravel()[at] -= share
    dh = (z @ w["out"].T).reshape(many, WINDOW, WIDTH)
    ds = np.matmul(dh, v.transpose(0, 2, 1))
    ds -= np.einsum("ijk,ijk->ij", dh, mixed)[:, :, None]  # a row's attention times its gradient sums to this
    ds *= a
    back = np.empty((many, WINDOW, 3 * WIDTH), np.float32)
    np.matmul(ds, k, out=back[:, :, :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=back[:, :, WIDTH : 2 * WIDTH])
    np.matmul(a.transpose(0, 2, 1), dh, out=back[:, :, 2 * WIDTH :])
    g_place = (np.ones(many, np.float32) @ back.reshape(many, -1)).reshape(WINDOW, -1)
    back = back.reshape(n, -1)
    dx = back @ three.T
    dx += dh.reshape(n, -1)
    return loss, (z.T @ h).T, np.ones(n, np.float32) @ z, g_place, (back.T @ x).T, dx


def step(w: dict[str, np.ndarray], state: dict[str, np.ndarray], slots: np.ndarray, classes: np.ndarray, mask: np.ndarray, rate: float) -> float:
    """One AdaGrad step on a batch of windows; the mean loss before it."""
    # the scale of the attention's products is in the query's weights, and again in their gradients
    three = np.concatenate([w["query"] * _SCALE, w["key"], w["value"]], axis=1)
    at_place = np.concatenate([w["at_query"] * _SCALE, w["at_key"], np.zeros((WINDOW, WIDTH), np.float32)], axis=1)
    table = w["embed"] @ three
    share = mask.astype(np.float32) / np.float32(max(float(mask.sum()), 1.0))
    parts = [slice(lo, lo + TOGETHER) for lo in range(0, len(slots), TOGETHER)]
    *sums, rows = zip(*(_gradients(w, three, table, at_place, slots[p], classes[p], share[p].ravel()) for p in parts))
    loss, g_out, g_bias, g_place, g_three = (sum(x[1:], x[0]) for x in sums)
    cells = np.take(_CELLS, slots.ravel(), axis=0).ravel()
    g = {"out": g_out, "bias": g_bias, "at_query": g_place[:, :WIDTH] * _SCALE, "at_key": g_place[:, WIDTH : 2 * WIDTH]}
    g |= {"query": g_three[:, :WIDTH] * _SCALE, "key": g_three[:, WIDTH : 2 * WIDTH], "value": g_three[:, 2 * WIDTH :]}
    g["embed"] = np.bincount(cells, np.concatenate(rows).ravel(), w["embed"].size).reshape(-1, WIDTH).astype(np.float32)
    for name, d in g.items():
        state[name] += d * d
        w[name] -= (rate * d / np.sqrt(state[name])).astype(np.float32)
    return loss


def windows(lengths: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first place and whether it is the text's first, of all windows that cover texts of so many ids."""
    count = 1 + np.maximum(-(-(lengths - WINDOW) // stride), 0)
    text = np.repeat(np.arange(len(lengths)), count)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, turn * stride, turn == 0


def _seen(model: Model, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each id the slot before it, which predicts it: the end's before a text's first."""
    out = np.empty(len(ids), np.int32)
    out[1:] = model.slot[ids[:-1]]
    out[starts] = model.slot[model.end]
    return out


def _targets(starts: np.ndarray, lengths: np.ndarray, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that windows predict, and which of them are real and not behind the text's last."""
    at = place[:, None] + np.arange(WINDOW)[None, :]
    last = lengths[text][:, None] - 1
    return starts[text][:, None] + np.minimum(at, last), at <= last


def start_state(weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sums of squared gradients, which train() goes on with if it gets them again."""
    return {k: np.full_like(v, 1e-4) for k, v in weights.items()}


def train(model: Model, ids: np.ndarray, lengths: np.ndarray, rounds: int, rate: float, seed: int = 1, batch: int = 128, state: dict[str, np.ndarray] | None = None) -> float:
    """Train the model's weights in place on texts of ids (each ends with the end's id); the last round's mean loss."""
    starts = np.cumsum(lengths) - lengths
    text, place, _ = windows(lengths, WINDOW)
    seen, group = _seen(model, ids, starts), model.group[ids]
    random, state = np.random.default_rng(seed), start_state(model.weights) if state is None else state
    loss = 0.0
    for _ in range(rounds):
        order, losses = random.permutation(len(text)), []
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            target, real = _targets(starts, lengths, text[some], place[some])
            losses.append(step(model.weights, state, np.take(seen, target), np.take(group, target), real, rate))
        loss = float(np.mean(losses)) if losses else 0.0
    return loss


def log_probabilities(model: Model, ids: np.ndarray, lengths: np.ndarray, batch: int = 2 * TOGETHER) -> tuple[np.ndarray, np.ndarray]:
    """For each id its natural log probability, and that of any id that begins a word or ends the text in its place.

    Windows overlap: but for a text's first, a window's first ids are context, and each id is scored once.
    """
    w = model.weights
    logp, begins = np.zeros(len(ids)), np.zeros(len(ids))
    if not len(ids):
        return logp, begins
    starts = np.cumsum(lengths) - lengths
    seen, group = _seen(model, ids, starts), model.group[ids]
    within = np.log(model.share(seen, ids))
    text, place, first = windows(lengths, WINDOW - CONTEXT)
    # what a slot gives to the layer is looked up, not multiplied again: query, key, value, and its own part of the classes' sums
    queries, keys, values = w["embed"] @ (w["query"] * _SCALE), w["embed"] @ w["key"], w["embed"] @ w["value"]
    direct = w["embed"] @ w["out"] + w["bias"]
    # attention mixes values with weights that sum to one, so no sum is beyond this
    clipped = float(np.abs(direct).max() + np.abs(values @ w["out"]).max()) > 60
    sides = np.stack([np.ones(CLASSES), np.arange(CLASSES) < STARTS], axis=1).astype(np.float32)
    cell = np.arange(batch * WINDOW) * CLASSES
    # context has keys and values, but asks nothing
    for begin, some in ((0, np.flatnonzero(first)), (CONTEXT, np.flatnonzero(~first))):
        at_query, causal = w["at_query"][begin:] * _SCALE, _CAUSAL[begin:]
        for lo in range(0, len(some), batch):
            part = some[lo : lo + batch]
            target, real = _targets(starts, lengths, text[part], place[part])
            slots, at, real = np.take(seen, target), target[:, begin:].ravel(), real[:, begin:].ravel()
            own = np.ascontiguousarray(slots[:, begin:])
            q, k = np.take(queries, own, axis=0), np.take(keys, slots, axis=0)
            q += at_query
            k += w["at_key"]
            a = np.matmul(q, k.transpose(0, 2, 1))
            np.clip(a, -_LIMIT, _LIMIT, out=a)
            np.exp(a, out=a)
            a *= causal
            mixed = np.matmul(a, np.take(values, slots, axis=0))
            mixed /= a @ _ONES[:WINDOW]
            z = mixed.reshape(-1, WIDTH) @ w["out"]
            z += np.take(direct, own.ravel(), axis=0)
            if clipped:
                np.clip(z, -60, 60, out=z)
            chosen = np.take(z, cell[: len(at)] + np.take(group, at))
            np.exp(z, out=z)
            sums = np.log(z @ sides)
            total, at = sums[:, 0], at[real]
            logp[at] = (chosen - total)[real]
            begins[at] = (sums[:, 1] - total)[real]
    logp += within
    return logp, begins


def chosen(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By the counts of all ids (the end's is the last): those with a slot of their own, and those that tell ids apart as neighbours."""
    order = np.argsort(-count, kind="stable")
    top = order[: SLOTS - 1]
    return top[(count[top] > 0) & (top != len(count) - 1)], order[:NEIGHBOURS]


def neighbours(ids: np.ndarray, tokens: int, top: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How often each of `most` stands before and behind each of `top` in texts of ids, with the end before a text's first."""
    rank, column = np.full(tokens + 1, -1), np.full(tokens + 1, -1)
    rank[top], column[most] = np.arange(len(top)), np.arange(len(most))
    wide = 2 * len(most)
    ids = np.concatenate([[tokens], ids])
    r, c = rank[ids], column[ids]
    before, behind = np.flatnonzero((r[1:] >= 0) & (c[:-1] >= 0)), np.flatnonzero((r[:-1] >= 0) & (c[1:] >= 0))
    cells = np.concatenate([r[before + 1] * wide + c[before], r[behind] * wide + len(most) + c[behind + 1]])
    return np.bincount(cells, minlength=len(top) * wide).reshape(len(top), wide)


def cluster(ids: np.ndarray, tokens: int, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and slot of each id by all texts at once."""
    count = np.bincount(ids, minlength=tokens + 1)
    top, most = chosen(count)
    return classes(count, top, neighbours(ids, tokens, top, most), begins)


def classes(count: np.ndarray, top: np.ndarray, context: np.ndarray, begins: np.ndarray, seed: int = 1, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Class and slot of each id (the end's is the last): ids with alike neighbours share a class.

    begins: whether an id begins a word.  Ids that aren't in `top` join their side's first class.
    """
    tokens = len(count) - 1
    context = np.sqrt(context / np.maximum(context.sum(axis=1, keepdims=True), 1))
    group = np.where(begins, 0, STARTS).astype(np.int64)
    random = np.random.default_rng(seed)
    for first, many, side in ((0, STARTS - 1, begins[top]), (STARTS, OTHERS, ~begins[top])):
        members = np.flatnonzero(side)
        if not len(members):
            continue
        x, weight = context[members], np.sqrt(count[top[members]])
        centres = x[random.choice(len(x), min(many, len(x)), replace=False, p=weight / weight.sum())]
        nearest = np.zeros(len(x), np.int64)
        for _ in range(rounds):
            nearest = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) if len(x) * len(centres) * x.shape[1] < 2e7 else (-2 * x @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)
            for c in range(len(centres)):
                if (own := nearest == c).any():
                    centres[c] = np.average(x[own], axis=0, weights=weight[own])
        group[top[members]] = first + nearest
    group[tokens] = STARTS - 1
    slot = np.where(begins, SLOTS, SLOTS + 1)  # rare ids share a slot for each side
    slot[top] = np.arange(len(top))
    slot[tokens] = SLOTS - 1
    return group, slot
