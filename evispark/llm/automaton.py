"""One minimal deterministic automaton for many byte patterns.

Patterns (literals, ``\\xNN``, classes, groups, ``|``, ``? * + {m,n}``) are parsed to a small tree, laid out
as a nondeterministic automaton, made deterministic by subset construction over byte classes, and minimised
by partition refinement. The result is a flat transition array that numpy walks for many stretches of the
input at once. Byte 0 belongs to no pattern, so texts joined by it are scanned together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ANY = frozenset(range(1, 256))


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def alternatives(self):
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, None))
            if c == "{":
                stop = self.p.index("}", self.i)
                first, comma, last = self.p[self.i : stop].partition(",")
                low, high = int(first), (int(last) if last else None) if comma else int(first)
                self.i = stop + 1
            node = ("rep", node, low, high)
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            node = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.take()
            return node
        if c == "[":
            return ("set", self.charset())
        if c == ".":
            return ("set", ANY - {10})
        return ("set", frozenset([self.escaped() if c == "\\" else ord(c)]))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def charset(self) -> frozenset[int]:
        negated = self.peek() == "^"
        self.i += negated
        found: set[int] = set()
        while (c := self.take()) != "]":
            a = self.escaped() if c == "\\" else ord(c)
            b = a
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                c = self.take()
                b = self.escaped() if c == "\\" else ord(c)
            found.update(range(a, b + 1))
        return ANY - found if negated else frozenset(found - {0})


def parse(pattern: str):
    parser = _Parser(pattern)
    tree = parser.alternatives()
    if parser.i != len(pattern):
        raise ValueError(f"unexpected {parser.peek()!r} in {pattern!r}")
    return tree


class _Nfa:
    """eps: silent moves of each state; step: (bytes, next state) or None."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def add(self, node, start: int, backward: bool) -> int:
        """Lays node out from start; returns its last state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.step[start] = (node[1], end)
            end2 = self.state()
            self.eps[end].append(end2)
            return end2
        if kind == "cat":
            for part in reversed(node[1]) if backward else node[1]:
                start = self.add(part, start, backward)
            return start
        if kind == "alt":
            end = self.state()
            for branch in node[1]:
                first = self.state()
                self.eps[start].append(first)
                self.eps[self.add(branch, first, backward)].append(end)
            return end
        _, part, low, high = node
        for _ in range(low):
            start = self.add(part, start, backward)
        if high is None:
            first, end = self.state(), self.state()
            self.eps[start] += [first, end]
            self.eps[self.add(part, first, backward)] += [first, end]
            inner = self.state()
            self.eps[end].append(inner)
            return inner
        end = self.state()
        for _ in range(high - low):
            self.eps[start].append(end)
            first = self.state()
            self.eps[start].append(first)
            start = self.add(part, first, backward)
        self.eps[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Automaton:
    """classes: byte to class; table: premultiplied next state at state + class; accepts: patterns by state number."""

    classes: np.ndarray
    table: np.ndarray
    width: int
    start: int
    first_accepting: int
    accepts: list[tuple[int, ...]]

    def __post_init__(self) -> None:
        self._next, self._class = self.table.tolist(), self.classes.tolist()

    def hits(self, data: np.ndarray, lanes: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """Positions after whose byte some pattern accepts, and the state there, in one pass over data.

        The input is cut into stretches that advance together. Each begins in the start state; where the
        stretch before ends elsewhere, the head of the stretch is walked anew until both walks agree.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        lanes = max(1, min(lanes, n // 128))
        steps = -(-n // lanes)
        padded = np.zeros(steps * lanes, np.uint8)
        padded[:n] = data
        cls = np.ascontiguousarray(self.classes[padded].reshape(lanes, steps).T)
        seen = np.empty((steps, lanes), np.int32)
        state = np.full(lanes, self.start, np.int32)
        for k in range(steps):
            state = self.table.take(state + cls[k])
            seen[k] = state
        step_of = self._next
        for j in np.flatnonzero(seen[-1] != self.start).tolist():
            while j + 1 < lanes:
                s, column, old = int(seen[-1, j]), cls[:, j + 1].tolist(), seen[:, j + 1]
                for k, c in enumerate(column):
                    s = step_of[s + c]
                    if s == old[k]:
                        break
                    old[k] = s
                else:
                    j += 1
                    continue
                break
        rows, cols = np.nonzero(seen >= self.first_accepting)
        at = cols * steps + rows
        order = np.argsort(at)
        at = at[order]
        return at[at < n], seen[rows, cols][order][at < n]

    def longest(self, data: bytes, start: int) -> int:
        """End of the longest match that begins at start, or -1 (for an automaton built with anchored=True)."""
        s, best, step_of, cls, width = self.start, -1, self._next, self._class, self.width
        for i in range(start, len(data)):
            s = step_of[s + cls[data[i]]]
            if s >= self.first_accepting:
                best = i + 1
            elif s == 0:
                break
        return best


def build(patterns: list[str], backward: bool = False, anchored: bool = False) -> Automaton:
    """The minimal automaton of all patterns. backward: of their mirror images; anchored: matches begin at the first byte only."""
    nfa, root, ends = _Nfa(), None, {}
    root = nfa.state()
    for k, pattern in enumerate(patterns):
        first = nfa.state()
        nfa.eps[root].append(first)
        ends[nfa.add(parse(pattern), first, backward)] = k
    sets = sorted({s[0] for s in nfa.step if s}, key=sorted)
    marks: dict[tuple[bool, ...], int] = {}
    classes = np.array([marks.setdefault(tuple(b in s for s in sets), len(marks)) for b in range(256)], np.uint8)
    examples = [int(np.flatnonzero(classes == c)[0]) for c in range(len(marks))]
    begin = nfa.closure([root])
    always = frozenset() if anchored else begin
    dead = frozenset()
    number: dict[frozenset[int], int] = {dead: 0} if anchored else {}
    number.setdefault(begin, len(number))
    todo, rows = list(number), {}
    while todo:
        now = todo.pop()
        row = []
        for b in examples:
            to = nfa.closure({nfa.step[s][1] for s in now if nfa.step[s] and b in nfa.step[s][0]}) | always
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows[number[now]] = row
    table = np.array([rows[k] for k in range(len(number))], np.int64)
    accepts = [tuple(sorted({ends[s] for s in states if s in ends})) for states in number]
    kinds: dict[tuple[int, ...], int] = {}
    part = np.array([kinds.setdefault(a, len(kinds)) for a in accepts])
    while True:
        _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == part.max():
            break
        part = finer
    heads = {int(p): int(np.flatnonzero(part == p)[0]) for p in np.unique(part)}
    order = sorted(heads, key=lambda p: (bool(accepts[heads[p]]), heads[p]))
    if anchored:  # the dead state stays number 0
        order.sort(key=lambda p: (p != part[0], bool(accepts[heads[p]]), heads[p]))
    place = {p: k for k, p in enumerate(order)}
    width = len(examples)
    small = np.array([[place[int(part[t])] * width for t in table[heads[p]]] for p in order], np.int32).ravel()
    n_plain = sum(not accepts[heads[p]] for p in order)
    return Automaton(classes, small, width, place[int(part[number[begin]])] * width, n_plain * width, [accepts[heads[p]] for p in order])
