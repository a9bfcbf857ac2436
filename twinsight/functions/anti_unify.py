"""Anti-unification of two ordered trees: the most specific template of both, with holes where they differ.

A tree is (kind, label, children). Lists of children are aligned globally; children outside the alignment and nodes
that cannot be matched become holes. A pair of contents that stands in several places is one hole.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass
from typing import NamedTuple

#: Cost of a gap and offset of a match in the alignment; a product of lengths beyond LARGEST is one hole. Fixed values.
GAP, BIAS, LARGEST = -0.30, -0.35, 40_000
HOLE = "hole"


class Tree(NamedTuple):
    kind: str
    label: str | None = None
    children: tuple[Tree, ...] = ()


@dataclass
class Result:
    template: Tree
    divergence: float
    holes: int


class Comparison:
    """Sizes, hashes and holes of one comparison, each computed once for a node."""

    def __init__(self) -> None:
        self._size: dict[Tree, int] = {}
        self._bag: dict[Tree, Counter] = {}
        self.holes: dict[tuple, tuple[str, int]] = {}

    def size(self, t: Tree) -> int:
        if t not in self._size:
            self._size[t] = 1 + sum(self.size(c) for c in t.children)
        return self._size[t]

    def bag(self, t: Tree) -> Counter:
        """How often each subtree occurs in t."""
        if t not in self._bag:
            own = Counter([t])
            for c in t.children:
                own += self.bag(c)
            self._bag[t] = own
        return self._bag[t]

    def similar(self, a: Tree, b: Tree) -> float:
        if a == b:
            return 1.0
        x, y = self.bag(a), self.bag(b)
        both = (x & y).total()
        return both / (x.total() + y.total() - both)

    def hole(self, a: tuple[Tree, ...], b: tuple[Tree, ...]) -> Tree:
        key = (a, b)
        if key not in self.holes:
            self.holes[key] = (f"h{len(self.holes) + 1}", sum(map(self.size, a)) + sum(map(self.size, b)))
        return Tree(HOLE, self.holes[key][0])

    def unify(self, a: Tree, b: Tree) -> Tree:
        if a == b:
            return a
        if a.kind != b.kind or a.label != b.label:
            return self.hole((a,), (b,))
        return Tree(a.kind, a.label, tuple(self.align(a.children, b.children)))

    def align(self, xs: tuple[Tree, ...], ys: tuple[Tree, ...]) -> list[Tree]:
        if len(xs) * len(ys) > LARGEST:
            return [self.hole(xs, ys)]
        # best[i][j]: best score of xs[i:] and ys[j:]; ties prefer a match, then a gap in ys.
        n, m = len(xs), len(ys)
        gain = [[self.similar(x, y) + BIAS if x.kind == y.kind and x.label == y.label else None for y in ys] for x in xs]
        best = [[0.0] * (m + 1) for _ in range(n + 1)]
        for i in range(n, -1, -1):
            for j in range(m, -1, -1):
                if i == n or j == m:
                    best[i][j] = GAP * (n - i + m - j)
                    continue
                options = [best[i + 1][j] + GAP, best[i][j + 1] + GAP]
                if gain[i][j] is not None:
                    options.append(best[i + 1][j + 1] + gain[i][j])
                best[i][j] = max(options)
        out: list[Tree] = []
        left: list[Tree] = []
        right: list[Tree] = []
        i = j = 0

        def flush() -> None:
            if left or right:
                out.append(self.hole(tuple(left), tuple(right)))
                left.clear()
                right.clear()

        while i < n or j < m:
            if i < n and j < m and gain[i][j] is not None and abs(best[i][j] - (best[i + 1][j + 1] + gain[i][j])) < 1e-9:
                flush()
                out.append(self.unify(xs[i], ys[j]))
                i, j = i + 1, j + 1
            elif j == m or i < n and abs(best[i][j] - (best[i + 1][j] + GAP)) < 1e-9:
                left.append(xs[i])
                i += 1
            else:
                right.append(ys[j])
                j += 1
        flush()
        return out


def anti_unify(a: Tree, b: Tree) -> Result:
    """Template, share of both trees that lies in holes, and the number of different holes."""
    c = Comparison()
    template = c.unify(a, b)
    cost = sum(n for _, n in c.holes.values())
    return Result(template, cost / (2 * c.size(template)), len(c.holes))


def render(t: Tree, depth: int = 0) -> str:
    """The template as indented text, holes in angle brackets."""
    own = f"⟨{t.label}⟩" if t.kind == HOLE else t.kind if t.label is None else t.label
    return "\n".join(["  " * depth + own, *(render(c, depth + 1) for c in t.children)])


def fingerprint(t: Tree) -> str:
    """Identity of a template: kinds, labels and holes in order."""
    return hashlib.md5(repr(t).encode()).hexdigest()


def text_tree(text: str | None) -> Tree:
    """A text as lines of words."""
    lines = [line.lower().split() for line in (text or "").split("\n")]
    return Tree("text", None, tuple(Tree("line", None, tuple(Tree("word", w) for w in ws)) for ws in lines if ws))
