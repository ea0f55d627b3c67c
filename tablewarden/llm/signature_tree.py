"""Exact set-similarity self-join of one task's sets by a dual traversal of a signature tree.

A tree node holds the OR of its sets' token bitmaps and their range of sizes. A pair of nodes is left
out if no pair of sets below it can overlap enough. Sets that are known to be connected need no further
link, so pairs of nodes that lie in one component are left out too: the links that come back span the
components, and no link between different components is lost.
"""

from __future__ import annotations

import numpy as np

LEAF = 8
FANOUT = 4
BITS = 2048


class Forest:
    """Component labels of the sets, joined by relabelling the smaller side."""

    def __init__(self, labels: np.ndarray) -> None:
        _, self.of = np.unique(labels, return_inverse=True)
        self.of = self.of.astype(np.int64)
        self.members: dict[int, list[int]] = {}
        for i, c in enumerate(self.of.tolist()):
            self.members.setdefault(c, []).append(i)

    def join(self, a: int, b: int) -> bool:
        x, y = int(self.of[a]), int(self.of[b])
        if x == y:
            return False
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        self.of[self.members[y]] = x
        self.members[x] += self.members.pop(y)
        return True


def links(values: np.ndarray, bounds: np.ndarray, labels: np.ndarray | None = None, percent: int = 80) -> list[tuple[int, int]]:
    """Pairs of sets with ``100 * intersection >= percent * union`` that span all components.

    Set ``i`` is ``values[bounds[i]:bounds[i + 1]]``, distinct and not empty. Sets with equal ``labels``
    count as connected from the start.
    """
    n = len(bounds) - 1
    if n < 2:
        return []
    size = np.diff(bounds)
    _, token = np.unique(values, return_inverse=True)
    # like sets stand together: order by smallest fingerprint, then size
    order = np.lexsort((size, np.minimum.reduceat(values, bounds[:-1])))
    token = np.concatenate([token[bounds[i] : bounds[i + 1]] for i in order])
    size = size[order]
    start = np.concatenate([[0], np.cumsum(size)])
    forest = Forest(np.arange(n) if labels is None else labels[order])
    tree = _Tree(token, start, size)
    masks = np.zeros(int(token.max()) + 1, np.uint32)
    out: list[tuple[int, int]] = []
    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        a, b = tree.span(level, i), tree.span(level, j)
        of_a, of_b = forest.of[a[0] : a[1]], forest.of[b[0] : b[1]]
        if of_a[0] == of_b[0] and (of_a == of_a[0]).all() and (of_b == of_b[0]).all():
            continue
        if i != j and not tree.may_link(level, i, j, percent):
            continue
        if level:
            for x in tree.children(level, i):
                stack += [(level - 1, x, y) for y in tree.children(level, j) if i != j or x <= y]
            continue
        for x, y in _compare(token, start, size, a, b, masks, percent):
            if x != y and forest.join(x, y):
                out.append((int(order[x]), int(order[y])))
    return out


def _compare(token, start, size, a, b, masks, percent):
    """Pairs of sets of two leaves that are similar enough, counted exactly."""
    for k in range(a[0], a[1]):
        masks[token[start[k] : start[k + 1]]] |= np.uint32(1 << (k - a[0]))
    met = masks[token[start[b[0]] : start[b[1]]]]
    at = start[b[0] : b[1]] - start[b[0]]
    for k in range(a[0], a[1]):
        common = np.add.reduceat((met >> np.uint32(k - a[0])) & np.uint32(1), at).astype(np.int64)
        for y in np.flatnonzero(100 * common >= percent * (size[k] + size[b[0] : b[1]] - common)).tolist():
            if a[0] != b[0] or k < b[0] + y:
                yield k, b[0] + y
    masks[token[start[a[0]] : start[a[1]]]] = 0


class _Tree:
    def __init__(self, token: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.n = len(size)
        leaves = -(-self.n // LEAF)
        bit = token % BITS
        owner = np.repeat(np.arange(self.n), size)
        per_set = np.bincount(np.unique(owner * BITS + bit) // BITS, minlength=self.n)
        flags = np.zeros((leaves, BITS), dtype=bool)
        flags[owner // LEAF, bit] = True
        cuts = np.arange(0, self.n, LEAF)
        self.levels = [(np.packbits(flags, axis=1).view(np.uint64), np.minimum.reduceat(size, cuts), np.maximum.reduceat(size, cuts), np.maximum.reduceat(size - per_set, cuts))]
        while len(self.levels[-1][1]) > 1:
            bits, least, most, spare = self.levels[-1]
            cuts = np.arange(0, len(least), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, cuts, axis=0), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts), np.maximum.reduceat(spare, cuts)))

    def span(self, level: int, i: int) -> tuple[int, int]:
        width = LEAF * FANOUT**level
        return i * width, min((i + 1) * width, self.n)

    def children(self, level: int, i: int) -> range:
        return range(i * FANOUT, min((i + 1) * FANOUT, len(self.levels[level - 1][1])))

    def may_link(self, level: int, i: int, j: int, percent: int) -> bool:
        """Whether two sets below could overlap enough: by size, and by the bits the nodes share. A set's
        tokens beyond its own bits (``spare``) may lie anywhere; the others need a shared bit."""
        bits, least, most, spare = self.levels[level]
        if 100 * min(most[i], most[j]) < percent * max(least[i], least[j]):
            return False
        shared = int(np.bitwise_count(bits[i] & bits[j]).sum())
        overlap = min(shared + min(int(spare[i]), int(spare[j])), int(most[i]), int(most[j]))
        return overlap * (100 + percent) >= percent * int(least[i] + least[j])
