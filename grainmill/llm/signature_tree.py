"""Signature trees: nodes hold the OR of their members' token bitmaps, the range of their sizes and the largest
number of tokens that share a bit; dual traversal prunes pairs of nodes by the largest overlap they allow.

A bitmap has a power of two of at least 2 bits per token (a token's bit is its hash modulo the width), so a wider
one folds to a narrower one. Shared tokens share bits, hence for sets a and b, and for nodes above them,
overlap <= shared bits + min(tokens beyond one per bit); a link needs 9 * overlap >= 4 * (size a + size b),
which is a Jaccard similarity of 0.8.

Members are ordered by size class and then by content, so that near copies share a leaf and its bitmap stays sparse.
Only what the links connect is wanted: the traversal starts within nodes, and a pair of nodes whose members are all
connected already is not entered, so that a large group of near copies costs little more than its leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

LEAF, FANOUT = 32, 4
MIN_BITS, MAX_BITS = 256, 1 << 20
STEP = 8  # size classes of the members' order, per factor of 1.25


def bits_for(size: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (2 * max(size, 1) - 1).bit_length()))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """As 64-bit words."""
    width = bits_for(len(tokens))
    out = np.zeros(width, np.uint8)
    out[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(maps: np.ndarray) -> np.ndarray:
    """Rows of bitmaps at half their width."""
    half = maps.shape[1] // 2
    return maps[:, :half] | maps[:, half:]


@dataclass
class Node:
    first: int
    last: int
    any_bits: np.ndarray
    least: int
    most: int
    excess: int
    below: list["Node"]
    one: int = -1  # a member, once all are known to be connected

    def connected(self, who: np.ndarray, links: "Union") -> bool:
        if self.one < 0:
            if self.below:
                if not all(n.connected(who, links) for n in self.below):
                    return False
                each = [n.one for n in self.below]
            else:
                each = who[self.first : self.last].tolist()
            if len({links.find(k) for k in each}) > 1:
                return False
            self.one = each[0]
        return True


class Tree:
    """Over members sorted by size; `maps` has one row each, `who` their places outside."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, who: np.ndarray) -> None:
        order = np.lexsort((maps[:, 0], np.floor(np.log(np.maximum(sizes, 1)) * (STEP / np.log(1.25)))))
        self.maps, self.sizes, self.who = maps[order], sizes[order], who[order]
        self.excess = self.sizes - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        level = [self._node(a, min(a + LEAF, len(order)), []) for a in range(0, len(order), LEAF)]
        while len(level) > 1:
            level = [self._node(part[0].first, part[-1].last, part) for part in (level[k : k + FANOUT] for k in range(0, len(level), FANOUT))]
        self.root = level[0]

    def _node(self, a: int, b: int, below: list[Node]) -> Node:
        any_bits = np.bitwise_or.reduce([n.any_bits for n in below] if below else self.maps[a:b], axis=0)
        return Node(a, b, any_bits, int(self.sizes[a:b].min()), int(self.sizes[a:b].max()), int(self.excess[a:b].max()), below)


def _possible(a: Node, b: Node) -> bool:
    if 5 * a.most < 4 * b.least or 5 * b.most < 4 * a.least:
        return False
    shared = int(np.bitwise_count(a.any_bits & b.any_bits).sum()) + min(a.excess, b.excess)
    return 9 * shared >= 4 * (a.least + b.least)


def dual(s: Tree, t: Tree, links: "Union | None" = None) -> Iterator[tuple[int, int]]:
    """Pairs of members, as places outside, that the bounds allow; with s is t each pair once. Pairs that `links`,
    which the caller extends meanwhile, already connects may be left out."""
    todo = [(s.root, t.root)]
    while todo:
        a, b = todo.pop()
        if not _possible(a, b):
            continue
        if links and a.connected(s.who, links) and b.connected(t.who, links) and links.find(a.one) == links.find(b.one):
            continue
        if a.below and (not b.below or a.last - a.first >= b.last - b.first):
            if a is b:
                todo += [(x, y) for k, x in enumerate(a.below) for y in a.below[k + 1 :]]
                todo += [(x, x) for x in a.below]  # taken first
            else:
                todo += [(x, b) for x in a.below]
        elif b.below:
            todo += [(a, y) for y in b.below]
        else:
            m, n = s.sizes[a.first : a.last, None], t.sizes[None, b.first : b.last]
            right, left = t.maps[b.first : b.last], s.maps[a.first : a.last]
            shared = np.empty((len(left), len(right)), np.int64)
            for k in range(len(left)):
                shared[k] = np.bitwise_count(right & left[k]).sum(1)
            shared += np.minimum(s.excess[a.first : a.last, None], t.excess[None, b.first : b.last])
            ok = (9 * shared >= 4 * (m + n)) & (5 * m >= 4 * n) & (5 * n >= 4 * m)
            if a is b:
                ok &= np.triu(np.ones_like(ok), 1)
            for x, y in zip(*np.nonzero(ok), strict=True):
                yield int(s.who[a.first + x]), int(t.who[b.first + y])


def candidates(maps: list[np.ndarray], sides: list[int], sizes: list[int], links: "Union | None" = None) -> Iterator[tuple[int, int]]:
    """Pairs of members that may link. sides: 0 or 1; pairs within one side if all are on side 0, else across. Members
    of one bitmap width are a tree; it meets itself and, folded, the tree of the next narrower width, since the
    sizes of linked sets are less than a factor of two apart."""
    classes: dict[tuple[int, int], list[int]] = {}
    for k, m in enumerate(maps):
        classes.setdefault((len(m), sides[k]), []).append(k)
    trees: dict[tuple, Tree] = {}

    def tree(width: int, side: int, folded: bool) -> Tree | None:
        key = (width, side, folded)
        if key not in trees:
            who = classes.get((width * 2 if folded else width, side))
            if who:
                rows = np.stack([maps[k] for k in who])
                trees[key] = Tree(fold(rows) if folded else rows, np.array([sizes[k] for k in who], np.int64), np.array(who))
            else:
                trees[key] = None
        return trees[key]

    across = 1 in sides
    for width in sorted({w for w, _ in classes}):
        pairs = [((width, 0, False), (width, int(across), False)), ((width, 0, False), (width, int(across), True))]
        if across:
            pairs.append(((width, 0, True), (width, 1, False)))
        for p, q in pairs:
            s, t = tree(*p), tree(*q)
            if s and t:
                yield from dual(s, t, links)
        for key in [k for k in trees if k[0] == width and k[2]]:
            del trees[key]


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
