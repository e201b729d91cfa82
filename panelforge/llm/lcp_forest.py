"""A trie's nodes from sorted sequences, by union-find over the edges between neighbours.

The edge between two neighbours is as deep as their longest common prefix (LCP). Edges are
taken from the deepest up; each unites the components of its two sequences, and where
components meet there is a branching node, whose members are the sequences of the united
component. Between two branching nodes a component has a chain of nodes with one child each.

A run of sequences that continues before and after it knows all nodes but those that hold
its first or its last sequence. ``forest`` then closes the others and contracts the run to
these two sequences: what hangs on their nodes is kept as sums by depth. Contracted runs are
sequences again, with sums, so that neighbouring runs are merged by the same function.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Bytes that stand for one turn in a sequence.
KEY_BYTES = 16


class Entry:
    """Sums of the sequences that reach a node, so far.

    ``leaves`` and ``saved`` are of the subtrees below; ``ends`` describes the sequences that
    end here; ``labels`` name contracted sequences that hold the node; ``rows`` are its
    children's rows, which wait for the node's name.
    """

    __slots__ = ("n", "least", "children", "leaves", "saved", "ends", "labels", "rows")

    def __init__(self, n, least, children=0, leaves=0, saved=0, ends=None, labels=None, rows=None):
        self.n, self.least, self.children, self.leaves = n, least, children, leaves
        self.saved, self.ends = saved, ends
        self.labels, self.rows = labels or [], rows or []

    def add(self, other: Entry) -> None:
        self.n += other.n
        self.least = min(self.least, other.least)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends
        self.labels = _joined(self.labels, other.labels)
        self.rows = _joined(self.rows, other.rows)

    def __reduce__(self):
        parts = (self.n, self.least, self.children, self.leaves, self.saved, self.ends, self.labels)
        return Entry, parts


def _joined(a: list, b: list) -> list:
    """Both lists in one; the shorter is copied."""
    if len(a) < len(b):
        a, b = b, a
    a += b
    return a


@dataclass
class Sequence:
    """``keys``: the turns, ``KEY_BYTES`` each; ``sizes``: what sharing a turn saves.

    Sequences of different ``group`` have different tries. ``sums`` has an ``Entry`` by depth;
    a sequence of its own has one, at its end.
    """

    group: tuple
    keys: bytes
    sizes: list[int]
    sums: dict[int, Entry]


@dataclass
class Found:
    """Nodes, names of nodes by label, roots' sums by group, and the contracted run.

    A node is [name, depth, parent's name, n, children, leaves, saved, ends, run, side]; the
    last two say which contracted sequence holds the parent, if its name is not known here.
    """

    nodes: list[list] = field(default_factory=list)
    names: list[tuple] = field(default_factory=list)
    roots: list[tuple] = field(default_factory=list)
    ends: list[Sequence] = field(default_factory=list)


class _Component:
    """United sequences, as the node at ``depth`` that is being summed, and those above."""

    __slots__ = ("group", "sizes", "sums", "depth", "at", "side")

    def __init__(self, sequence: Sequence, side: int | None):
        self.group, self.sizes, self.sums = sequence.group, sequence.sizes, dict(sequence.sums)
        self.side, self.depth, self.at = side, None, None
        if side is None:
            self.depth = max(self.sums)
            self.at = self.sums.pop(self.depth)

    def lift(self, to: int, found: Found, root_nodes: bool) -> None:
        """Close the nodes below depth ``to`` and stand at it."""
        while self.depth > to:
            at, depth = self.at, self.depth
            leaves = at.leaves if at.children else 1
            for row in at.rows:
                row[2] = at.least
            for run, side in at.labels:
                found.names.append((run, side, depth, at.least))
            row = []
            if depth == 0 and not root_nodes:
                found.roots.append((*self.group, at.children, leaves, at.saved, at.ends))
                saved = at.saved
            else:
                saved = at.saved + (at.n - 1) * (self.sizes[depth - 1] if depth else 0)
                row = [at.least, depth, None, at.n, at.children, leaves, saved, at.ends, None, None]
                found.nodes.append(row)
            self.depth = depth - 1
            self.at = Entry(at.n, at.least, 1, leaves, saved, rows=[row])
            if self.depth in self.sums:
                self.at.add(self.sums.pop(self.depth))

    def unite(self, other: _Component) -> None:
        """Both stand at the same depth; the nodes above are common."""
        self.at.add(other.at)
        self._share(other)

    def _share(self, other: _Component) -> None:
        if len(self.sums) < len(other.sums):
            self.sums, other.sums = other.sums, self.sums
        for depth, entry in other.sums.items():
            if depth in self.sums:
                self.sums[depth].add(entry)
            else:
                self.sums[depth] = entry

    def hang(self, other: _Component, run: str) -> None:
        """Keep what stands at a node that is not closed here, and at those above."""
        for row in other.at.rows:
            row[8], row[9] = run, self.side
        other.at.rows = []
        other.at.labels.append((run, self.side))
        other.sums[other.depth] = other.at
        self._share(other)


def common(a: bytes, b: bytes) -> int:
    """Turns of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b)) // KEY_BYTES
    while low < high:
        middle = (low + high + 1) // 2
        span = slice(low * KEY_BYTES, middle * KEY_BYTES)
        if a[span] == b[span]:
            low = middle
        else:
            high = middle - 1
    return low


def forest(sequences: list[Sequence], run: str, final: bool, root_nodes: bool) -> Found:
    """The nodes of sorted sequences; with ``final`` nothing comes before or after them.

    With ``root_nodes`` the roots are nodes, else they are only summed up.
    """
    found, last = Found(), len(sequences) - 1
    if last < 0:
        return found
    sides = {} if final else {last: 1, 0: 0}
    components = [_Component(s, sides.get(i)) for i, s in enumerate(sequences)]
    above = list(range(len(sequences)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    edges = []
    for i, (a, b) in enumerate(zip(sequences[:-1], sequences[1:], strict=True)):
        if a.group == b.group:
            edges.append((common(a.keys, b.keys), i))
    edges.sort(key=lambda edge: -edge[0])
    for depth, i in edges:
        a, b = top(i), top(i + 1)
        left, right = components[a], components[b]
        if left.side is not None and right.side is not None:
            continue  # the first and the last sequence: only a merge of runs closes these
        for one in (left, right):
            if one.side is None:
                one.lift(depth, found, root_nodes)
        if left.side is not None:
            left.hang(right, run)
        elif right.side is not None:
            right.hang(left, run)
            a, b = b, a
        else:
            left.unite(right)
        above[b] = a
    for i, component in enumerate(components):
        if above[i] == i and component.side is None:
            component.lift(-1, found, root_nodes)
    for i in sorted(sides):
        own = sequences[i]
        for entry in components[i].sums.values():
            entry.labels = list(dict.fromkeys(entry.labels))
        found.ends.append(Sequence(own.group, own.keys, own.sizes, components[i].sums))
    return found
