"""Several regular expressions as one deterministic automaton over bytes.

Each rule's expression becomes a nondeterministic automaton; the subset construction makes one deterministic automaton of all of them, which Moore's
refinement minimises into a transition array of states by byte classes. It reads backwards: the state at a byte tells which rules
have a match that begins there, so one pass over the bytes finds the beginnings for all rules. The pass runs in many lanes of the buffer at once; a
lane that began in another state than its neighbour ended in is run again until both agree. From the beginnings that count, which are
few, a rule's own forward automaton goes to the longest end.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

#: Never part of UTF-8 nor of a rule: between two texts of a buffer.
BETWEEN = b"\xff"
#: Lanes of a pass, and bytes of a block: longer buffers go in blocks.
LANES, BLOCK = 8192, 4 << 20


class Rule(NamedTuple):
    """A match must have at least `tail` characters from the first one on at which it could end. Letters count in either case if `any_case` is set."""

    kind: str
    pattern: str
    tail: int = 1
    any_case: bool = False


# Expressions: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most or None)
_TOKEN = re.compile(r"\\x([0-9A-Fa-f]{2})|\\(\W)|\{(\d+)(,?)(\d*)\}|([()|?*+\[])|([^\\{}\]])", re.S)
_MEMBER = re.compile(r"\\x([0-9A-Fa-f]{2})|\\?(.)", re.S)


def parse(pattern: str, any_case: bool = False) -> tuple:
    """Of literals, classes of listed ASCII characters and ranges, groups, alternatives and repetitions: the regular part of the usual syntax. Anything else is an error."""
    at = 0

    def one(char: str) -> tuple:
        return ("set", frozenset(b for c in ({char.lower(), char.upper()} if any_case else {char}) for b in c.encode("ascii")))

    def members() -> tuple:
        nonlocal at
        found: set[int] = set()
        while pattern[at] != "]" or not found:
            pair = []
            for _ in range(2):
                m = _MEMBER.match(pattern, at)
                at = m.end()
                pair.append(int(m[1], 16) if m[1] else ord(m[2]))
                if not (pattern[at] == "-" and pattern[at + 1] != "]") or len(pair) == 2:
                    break
                at += 1
            found.update(range(pair[0], pair[-1] + 1))
        at += 1
        if max(found) > 0x7F:
            raise ValueError(f"not ASCII in {pattern!r}")
        return ("set", frozenset(b for f in found for c in ({chr(f).lower(), chr(f).upper()} if any_case else {chr(f)}) for b in c.encode("ascii")))

    def alternatives() -> tuple:
        nonlocal at
        branches: list[list[tuple]] = [[]]
        while at < len(pattern) and pattern[at] != ")":
            m = _TOKEN.match(pattern, at)
            if not m or pattern.startswith("[^", at) or pattern.startswith("(?", at) or m[7] in (".", "^", "$"):
                raise ValueError(f"unsupported at {at} in {pattern!r}")
            at = m.end()
            parts = branches[-1]
            if m[1]:
                parts.append(one(chr(int(m[1], 16))))
            elif m[2] or m[7]:
                parts.append(one(m[2] or m[7]))
            elif m[6] == "[":
                parts.append(members())
            elif m[6] == "(":
                parts.append(alternatives())
                at += 1
            elif m[6] == "|":
                branches.append([])
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(m[6]) or (int(m[3]), int(m[5]) if m[5] else None if m[4] else int(m[3]))
                parts[-1] = ("rep", parts[-1], least, most)
        return ("alt", tuple(("cat", tuple(b)) for b in branches))

    tree = alternatives()
    if at != len(pattern):
        raise ValueError(f"unbalanced: {pattern!r}")
    return tree


def backwards(tree: tuple) -> tuple:
    kind, parts = tree[0], tree[1]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", backwards(parts), *tree[2:])
    return (kind, tuple(backwards(p) for p in (reversed(parts) if kind == "cat" else parts)))


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []  # moves without a byte
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def new(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Adds an expression from a state on; its last state."""
        kind, part = tree[0], tree[1]
        if kind == "set":
            self.moves[start].append((part, end := self.new()))
        elif kind == "cat":
            end = start
            for p in part:
                end = self.add(p, end)
        elif kind == "alt":
            end = self.new()
            for p in part:
                begin = self.new()
                self.free[start].append(begin)
                self.free[self.add(p, begin)].append(end)
        else:
            least, most = tree[2:]
            end = start
            for _ in range(least):
                end = self.add(part, end)
            if most is None:
                again, after = self.new(), self.new()
                self.free[end] += [again, after]
                self.free[self.add(part, again)] += [again, after]
                return after
            skips = [end]
            for _ in range(most - least):
                begin = self.new()
                self.free[end].append(begin)
                end = self.add(part, begin)
                skips.append(end)
            after = self.new()
            for s in skips:
                self.free[s].append(after)
            end = after
        return end

    def closed(self, states: Iterable[int]) -> frozenset[int]:
        found, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in found:
                found.add(s)
                todo += self.free[s]
        return frozenset(found)


class Automaton(NamedTuple):
    """table[state, class]; classes: of each byte, 0 for bytes that no rule has; rules: bits of the rules that a state accepts. State 0 is the first, and accepting states come last."""

    table: np.ndarray
    classes: np.ndarray
    rules: np.ndarray

    @property
    def accepting(self) -> int:
        """The first accepting state."""
        return int(np.argmax(self.rules > 0)) if self.rules.any() else len(self.rules)


def compiled(trees: list[tuple], floating: bool) -> Automaton:
    """The minimal deterministic automaton of some expressions, by subset construction. floating: a match may begin at any byte."""
    nfa = _Nfa()
    begin, ends = nfa.new(), []
    for tree in trees:
        nfa.free[begin].append(start := nfa.new())
        ends.append(nfa.add(tree, start))
    # bytes that are in the same sets are one class
    sets = list({s for moves in nfa.moves for s, _ in moves})
    kinds: dict[tuple, int] = {(False,) * len(sets): 0}
    classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
    member = {s: [k for kind, k in kinds.items() if kind[i]] for i, s in enumerate(sets)}
    first = nfa.closed([begin])
    found, rows = {first: 0}, []
    order = [first]
    for subset in order:
        to: list[set[int]] = [set() for _ in kinds]
        for s in subset:
            for bytes_, target in nfa.moves[s]:
                for k in member[bytes_]:
                    to[k].add(target)
        row = []
        for targets in to:
            new = nfa.closed(targets) | (first if floating else frozenset())
            if new not in found:
                found[new] = len(found)
                order.append(new)
            row.append(found[new])
        rows.append(row)
    rules = np.array([sum(1 << i for i, e in enumerate(ends) if e in subset) for subset in order], np.int64)
    return _minimised(np.array(rows, np.int32), classes, rules)


def _minimised(table: np.ndarray, classes: np.ndarray, rules: np.ndarray) -> Automaton:
    """Moore's refinement: states are told apart by what they accept, then by the parts that their moves lead to, until no part splits."""
    part = np.unique(rules, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    # parts in a fixed order: that of the first state first, accepting ones last
    one = np.unique(part, return_index=True)[1]
    order = np.lexsort((one, np.arange(len(one)) != part[0], rules[one] > 0))
    number = np.empty(len(one), np.int32)
    number[order] = np.arange(len(one))
    return Automaton(number[part][table[one[order]]].astype(np.int32), classes, rules[one[order]])


class Scanner:
    """Finds all rules' matches: of each rule the leftmost ones that don't overlap, each as long as it can be, without those of too short a tail."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = tuple(rules)
        trees = [parse(r.pattern, r.any_case) for r in self.rules]
        self.back = compiled([backwards(t) for t in trees], floating=True)
        if self.back.rules[0]:
            raise ValueError("a rule matches the empty text")
        self.width = self.back.table.shape[1]
        self.moves = (self.back.table * self.width).ravel().astype(np.int32)  # states times width, for one addition a step
        self.ahead = []
        for tree in trees:
            own = compiled([tree], floating=False)
            dead = [i for i, row in enumerate(own.table.tolist()) if not own.rules[i] and set(row) == {i}]
            table = [[-1 if t in dead else t for t in row] for row in own.table.tolist()]
            self.ahead.append((table, own.classes.tobytes(), [bool(x) for x in own.rules]))

    def _lanes(self, codes: np.ndarray, state: int) -> np.ndarray:
        """The states of a backward pass over a block, state coming from its right; by steps and lanes. The block's size is a multiple of the lanes'."""
        lanes, steps = codes.shape[1], codes.shape[0]
        states = np.empty((steps, lanes), np.int32)
        now = np.zeros(lanes, np.int32)
        now[-1] = state
        began = now
        for j in range(steps):
            now = self.moves.take(now + codes[j], out=states[j])
        while True:
            comes = np.append(states[-1, 1:], np.int32(state))  # lanes lie from left to right, and are read from the right
            again = np.flatnonzero(comes != began)
            if not len(again):
                return states
            began, now = comes, comes[again]
            for j in range(steps):
                now = self.moves.take(now + codes[j, again])
                other = now != states[j, again]
                states[j, again] = now
                again, now = again[other], now[other]
                if not len(again):
                    break

    def beginnings(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places at which a match begins, in order, and the bits of their rules."""
        places, bits = [], []
        state, stop, limit = 0, len(data), self.back.accepting * self.width
        while stop:
            start = max(0, stop - BLOCK)
            lanes = max(1, min(LANES, (stop - start) // 64))
            steps = -(-(stop - start) // lanes)
            codes = np.zeros(lanes * steps, np.uint8)
            codes[lanes * steps - (stop - start) :] = self.back.classes[data[start:stop]]
            states = self._lanes(np.ascontiguousarray(codes.reshape(lanes, steps)[:, ::-1].T), state)
            at = np.flatnonzero(states.ravel() >= limit)
            place = stop - lanes * steps + (at % lanes + 1) * steps - 1 - at // lanes
            order = np.argsort(place)
            places.append(place[order])
            bits.append(self.back.rules[states.ravel()[at[order]] // self.width])
            pad = lanes * steps - (stop - start)  # lane 0 ends with padding, which is left of the block
            state, stop = (int(states[steps - 1 - pad, 0]) if pad < steps else 0), start
        return np.concatenate([*places[::-1], np.zeros(0, np.int64)]), np.concatenate([*bits[::-1], np.zeros(0, np.int64)])

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """start, rule and end of every match in a buffer of texts with BETWEEN between them, in order."""
        place, bits = self.beginnings(np.frombuffer(data, np.uint8))
        out = []
        for r, rule in enumerate(self.rules):
            mine = place[bits >> r & 1 > 0]
            i = 0
            while i < len(mine):
                start = int(mine[i])
                first, end = self._longest(r, data, start)
                if end - first + 1 >= rule.tail:
                    out.append((start, r, end))
                i = int(np.searchsorted(mine, end))
        return sorted(out)

    def _longest(self, r: int, data: bytes, at: int) -> tuple[int, int]:
        """The first and the last place at which a match that begins here can end."""
        table, classes, accepts = self.ahead[r]
        state, first, end = 0, 0, 0
        for at in range(at, len(data)):  # noqa: B020
            state = table[state][classes[data[at]]]
            if state < 0:
                break
            if accepts[state]:
                end = at + 1
                first = first or end
        return first, end
