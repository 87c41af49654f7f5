"""Prefix trees over globally ordered sets, and the links that they find.

A query walks the tree level by level: a segment's overlap with the query is counted once for all sets below it, and a subtree is left
when its remaining length can't reach the overlap that its sizes need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Union:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.up, self.size = list(range(n)), [1] * n

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.size[a] < self.size[b]:
                a, b = b, a
            self.up[b] = a
            self.size[a] += self.size[b]


def edge_batch(nodes: list[int], union: Union) -> pa.RecordBatch:
    """(node, root) of the nodes that aren't alone."""
    roots = [union.find(i) for i in range(len(nodes))]
    pairs = [(nodes[i], nodes[r]) for i, r in enumerate(roots) if i != r]
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


class Trie:
    """A path-compressed trie of sets of small numbers; segments are numbered by level."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        first, length, parent, depth = [0], [0], [-1], [0]  # of segments: place in `flat`, tokens, segment above, depth at the end
        flat, offsets, total = [], [], 0
        ends = [0] * len(sets)
        stack, last = [0], None
        for i in order:
            own = sets[i]
            offsets.append(total)
            if last is None:
                common = 0
            else:
                m = min(len(own), len(last))
                differ = np.flatnonzero(own[:m] != last[:m])
                common = int(differ[0]) if len(differ) else m
            while depth[stack[-1]] - length[stack[-1]] >= common and len(stack) > 1:
                stack.pop()
            top = stack[-1]
            if depth[top] > common:  # cut it in two: the upper part is new
                upper = len(first)
                keep = common - (depth[top] - length[top])
                first.append(first[top])
                length.append(keep)
                parent.append(parent[top])
                depth.append(common)
                first[top], length[top], parent[top] = first[top] + keep, length[top] - keep, upper
                stack[-1] = top = upper
            if len(own) > common:
                first.append(total + common)
                length.append(len(own) - common)
                parent.append(top)
                depth.append(len(own))
                stack.append(len(first) - 1)
            ends[i] = stack[-1]
            flat.append(own)
            total += len(own)
            last = own
        self.flat = np.concatenate(flat)
        parent_of = np.array(parent)
        level = np.zeros(len(first), dtype=np.int64)
        for s in range(len(first)):
            path, at = [], s
            while at and not level[at]:
                path.append(at)
                at = parent[at]
            for x in reversed(path):
                level[x] = level[parent[x]] + 1
        by_level = np.argsort(level, kind="stable")
        number = np.empty(len(first), dtype=np.int64)
        number[by_level] = np.arange(len(first))
        self.first, self.length, self.depth = (np.array(x)[by_level] for x in (first, length, depth))
        self.parent = np.where(parent_of[by_level] < 0, 0, number[parent_of[by_level]])
        self.bounds = np.searchsorted(level[by_level], np.arange(level.max() + 2))
        self.end, self.size = number[np.array(ends)], np.array([len(s) for s in sets], dtype=np.int64)
        self.least = np.full(len(first), np.iinfo(np.int64).max)
        self.most = np.zeros(len(first), dtype=np.int64)
        np.minimum.at(self.least, self.end, self.size)
        np.maximum.at(self.most, self.end, self.size)
        for at, stop in reversed(list(zip(self.bounds[1:-1], self.bounds[2:], strict=True))):
            np.minimum.at(self.least, self.parent[at:stop], self.least[at:stop])
            np.maximum.at(self.most, self.parent[at:stop], self.most[at:stop])

    def query(self, own: np.ndarray, mask: np.ndarray, percent: int, n: int | None = None) -> np.ndarray:
        """The stored sets that link to a set of `n` tokens, of which the trie knows `own`. `mask`: a cleared array over all tokens, cleared again afterwards."""
        mask[own] = True
        n = len(own) if n is None else n
        overlap = np.zeros(len(self.first), dtype=np.int64)
        alive = np.zeros(len(self.first), dtype=bool)
        alive[0] = True
        for at, stop in zip(self.bounds[1:-1], self.bounds[2:], strict=True):
            here = at + np.flatnonzero(alive[self.parent[at:stop]] & (100 * self.most[at:stop] >= percent * n) & (percent * self.least[at:stop] <= 100 * n))
            if not len(here):
                break
            lengths = self.length[here]
            begin = np.cumsum(lengths) - lengths
            hits = mask[self.flat[np.repeat(self.first[here] - begin, lengths) + np.arange(int(lengths.sum()))]]
            overlap[here] = overlap[self.parent[here]] + np.add.reduceat(hits.astype(np.int64), begin)
            bound = np.minimum(n, overlap[here] + self.most[here] - self.depth[here])
            alive[here] = (100 + percent) * bound >= percent * (n + self.least[here])
        mask[own] = False
        found = np.flatnonzero(alive[self.end])
        o = overlap[self.end[found]]
        return found[100 * o >= percent * (n + self.size[found] - o)]


def ranked(sets: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The sets as places in their common order, common digests first, so that paths are shared; the digests, their places and counts."""
    names, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(names), dtype=np.int64)
    place[np.argsort(-df, kind="stable")] = np.arange(len(names))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(x) for x in np.split(place[at], cuts)], names, place, df


def link(sets: list[np.ndarray], percent: int) -> Union:
    """Components of the sets' links. Every set outside the largest component has been asked in the end."""
    union = Union(len(sets))
    if len(sets) < 2:
        return union
    own, names, place, df = ranked(sets)
    by_place = np.empty(len(names), dtype=np.int64)
    by_place[place] = df
    central = [float(by_place[x].mean()) for x in own]
    trie, mask, asked = Trie(own), np.zeros(len(names), dtype=bool), [False] * len(sets)
    todo, best = sorted(range(len(sets)), key=lambda i: -central[i]), 0
    while todo:
        for i in todo:
            if union.size[union.find(i)] > 1 and union.find(i) == union.find(best):
                continue
            asked[i] = True
            for j in trie.query(own[i], mask, percent).tolist():
                union.join(i, j)
            if union.size[union.find(i)] > union.size[union.find(best)]:
                best = i
        largest = union.find(best)
        todo = [i for i in todo if not asked[i] and union.find(i) != largest]
    return union


def ask(queries: list[np.ndarray], stored: list[np.ndarray], percent: int) -> Union:
    """Components of the links between queries (numbered first) and stored sets."""
    union = Union(len(queries) + len(stored))
    if not queries or not stored:
        return union
    own, names, place, _ = ranked(stored)
    trie, mask = Trie(own), np.zeros(len(names), dtype=bool)
    for i, digests in enumerate(queries):
        at = np.minimum(np.searchsorted(names, digests), len(names) - 1)
        for j in trie.query(place[at[names[at] == digests]], mask, percent, len(digests)).tolist():
            union.join(i, len(queries) + j)
    return union
