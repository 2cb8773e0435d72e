"""A KD-tree over points of small whole numbers: orthogonal counts by subtree, and the points inside a box."""

from __future__ import annotations

import numpy as np

LEAF, QUERIES = 8, 64


class Tree:
    """Points (m, k) with a weight each; a node knows the bounds and the weight of all that is below it."""

    def __init__(self, points: np.ndarray, weights: np.ndarray) -> None:
        self.order = np.arange(len(points))
        low, high, total, span, child = [], [], [], [], []
        stack = [(0, len(points), -1)] if len(points) else []
        while stack:
            start, stop, above = stack.pop()
            own = self.order[start:stop]
            some, node = points[own], len(low)
            low.append(some.min(axis=0))
            high.append(some.max(axis=0))
            total.append(weights[own].sum())
            span.append((start, stop))
            child.append([-1, -1])
            if above >= 0:
                child[above][child[above][0] >= 0] = node
            wide = int(np.argmax(high[-1] - low[-1]))
            if stop - start > LEAF and high[-1][wide] > low[-1][wide]:
                half = (stop - start) // 2
                self.order[start:stop] = own[np.argpartition(some[:, wide], half)]
                stack += [(start, start + half, node), (start + half, stop, node)]
        self.points, self.weights = points[self.order], weights[self.order]
        self.low, self.high, self.total = np.array(low), np.array(high), np.array(total)
        self.span, self.child = np.array(span), np.array(child)

    def _visit(self, low: np.ndarray, high: np.ndarray):
        """(queries, nodes) wholly inside, then (queries, places of points) inside leaves that a box cuts, in turns."""
        for begin in range(0, len(low) * bool(len(self.low)), QUERIES):
            query = np.arange(begin, min(begin + QUERIES, len(low)))
            node = np.zeros(len(query), np.int64)
            while len(query):
                apart = ((self.low[node] > high[query]) | (self.high[node] < low[query])).any(axis=1)
                inside = ((self.low[node] >= low[query]) & (self.high[node] <= high[query])).all(axis=1)
                leaf = ~apart & ~inside & (self.child[node, 0] < 0)
                spans = self.span[node[leaf]]
                owner = np.repeat(query[leaf], spans[:, 1] - spans[:, 0])
                place = np.concatenate([np.arange(a, b) for a, b in spans]) if len(spans) else np.zeros(0, np.int64)
                fits = ((self.points[place] >= low[owner]) & (self.points[place] <= high[owner])).all(axis=1)
                yield query[inside], node[inside], owner[fits], place[fits]
                more = ~apart & ~inside & ~leaf
                query, node = np.repeat(query[more], 2), self.child[node[more]].ravel()

    def count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each box the weight of the points inside, bounds included."""
        out = np.zeros(len(low), np.int64)
        for query, node, owner, place in self._visit(low, high):
            np.add.at(out, query, self.total[node])
            np.add.at(out, owner, self.weights[place])
        return out

    def inside(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a box and a point inside it."""
        boxes, points = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for query, node, owner, place in self._visit(low, high):
            sizes = self.span[node, 1] - self.span[node, 0]
            boxes += [np.repeat(query, sizes), owner]
            points += [self.order[a:b] for a, b in self.span[node]] + [self.order[place]]
        return np.concatenate(boxes), np.concatenate(points)
