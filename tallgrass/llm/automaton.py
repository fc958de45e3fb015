"""Byte automata: rule regexes to NFA, subset construction, minimisation, transition arrays.

The syntax is that of regular expressions without look-around or references:
literals, classes over ASCII, groups, alternation, ? * + {m,n}, (?i:...).
"""

from __future__ import annotations

import re

import numpy as np

_ALL = frozenset(range(256))


class Nfa:
    """States with byte-set edges and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _members(items, fold: bool) -> frozenset:
    out: set[int] = set()
    negated = False
    for op, value in items:
        name = str(op)
        if name == "NEGATE":
            negated = True
        elif name == "LITERAL":
            out.add(value)
        elif name == "RANGE":
            out.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"unsupported in a class: {name}")
    if max(out, default=0) > 127:
        raise ValueError("classes are over ASCII")
    if fold:
        out |= {ord(chr(c).swapcase()) for c in out if chr(c).isalpha()}
    return frozenset(_ALL - out if negated else out)


def build(nfa: Nfa, pattern: str, backward: bool = False) -> tuple[int, int]:
    """Add pattern to nfa, reading its bytes from the end if backward; (first state, accepting state)."""
    parser = re._parser  # the standard library's own parser gives the syntax tree

    def sequence(items, fold: bool) -> tuple[int, int]:
        first = last = nfa.state()
        for item in list(items)[:: -1 if backward else 1]:
            a, b = one(item, fold)
            nfa.empty[last].append(a)
            last = b
        return first, last

    def symbol(members: frozenset) -> tuple[int, int]:
        a, b = nfa.state(), nfa.state()
        nfa.edges[a].append((members, b))
        return a, b

    def one(item, fold: bool) -> tuple[int, int]:
        op, value = item
        name = str(op)
        if name == "LITERAL":
            if value < 128:
                return symbol(_members([item], fold))
            raw = chr(value).encode()
            first = last = nfa.state()
            for byte in raw[:: -1 if backward else 1]:
                a, b = symbol(frozenset([byte]))
                nfa.empty[last].append(a)
                last = b
            return first, last
        if name == "IN":
            return symbol(_members(value, fold))
        if name == "ANY":
            return symbol(_ALL - {10})
        if name == "SUBPATTERN":
            _, added, _, inner = value
            return sequence(inner, fold or bool(added & re.IGNORECASE))
        if name == "BRANCH":
            a, b = nfa.state(), nfa.state()
            for option in value[1]:
                x, y = sequence(option, fold)
                nfa.empty[a].append(x)
                nfa.empty[y].append(b)
            return a, b
        if name == "MAX_REPEAT":
            low, high, inner = value
            first = last = nfa.state()
            for _ in range(low):
                a, b = sequence(inner, fold)
                nfa.empty[last].append(a)
                last = b
            if high is parser.MAXREPEAT or high > 1 << 16:
                a, b = sequence(inner, fold)
                end = nfa.state()
                nfa.empty[last] += [a, end]
                nfa.empty[b] += [a, end]
                return first, end
            end = nfa.state()
            for _ in range(high - low):
                nfa.empty[last].append(end)
                a, b = sequence(inner, fold)
                nfa.empty[last].append(a)
                last = b
            nfa.empty[last].append(end)
            return first, end
        raise ValueError(f"unsupported: {name}")

    return sequence(parser.parse(pattern), False)


class Dfa:
    """Minimised automaton as arrays.

    classes: byte to class. table[state + class] is the next state, states being
    multiples of width, so that a step is one addition and one look-up. Accepting
    states are those from ``accepting`` on; mask_of gives their rules as bits.
    State ``start`` begins; ``dead`` is the state without way out, or -1.
    """

    def __init__(self, patterns: list[str], *, search: bool, backward: bool, limit: int = 20_000):
        nfa = Nfa()
        root = nfa.state()
        if search:
            nfa.edges[root].append((_ALL, root))
        finals: dict[int, int] = {}
        for rule, pattern in enumerate(patterns):
            first, last = build(nfa, pattern, backward)
            nfa.empty[root].append(first)
            finals[last] = rule
        self._determinise(nfa, root, finals, limit)

    def _determinise(self, nfa: Nfa, root: int, finals: dict[int, int], limit: int) -> None:
        sets = list({members for edges in nfa.edges for members, _ in edges})
        signature: dict[tuple, int] = {}
        classes = np.zeros(256, dtype=np.int64)
        for byte in range(256):
            classes[byte] = signature.setdefault(tuple(byte in s for s in sets), len(signature))
        width = len(signature)
        sample = {c: b for b, c in enumerate(classes.tolist())}
        start = nfa.closure([root])
        index, rows, todo = {start: 0}, [], [start]
        while todo:
            states = todo.pop(0)
            row = []
            for c in range(width):
                to = nfa.closure({t for s in states for members, t in nfa.edges[s] if sample[c] in members})
                if to not in index:
                    index[to] = len(index)
                    todo.append(to)
                    if len(index) > limit:
                        raise ValueError(f"more than {limit} states")
                row.append(index[to])
            rows.append(row)
        table = np.array(rows, dtype=np.int64)
        masks = np.array([sum(1 << finals[s] for s in states if s in finals) for states in index], dtype=np.int64)
        self._minimise(table, masks, classes)

    def _minimise(self, table: np.ndarray, masks: np.ndarray, classes: np.ndarray) -> None:
        """Moore's refinement: states differ if their rules or their successors' groups do."""
        _, group = np.unique(masks, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == group.max():
                break
            group = finer
        count = int(group.max()) + 1
        chosen = np.array([int(np.flatnonzero(group == g)[0]) for g in range(count)])
        order = np.argsort(masks[chosen] > 0, kind="stable")
        rank = np.empty(count, dtype=np.int64)
        rank[order] = np.arange(count)
        width = table.shape[1]
        small = rank[group[table[chosen[order]]]]
        self.width = width
        self.classes = classes.astype(np.int32)
        self.table = (small * width).astype(np.int32).reshape(-1)
        self.masks = masks[chosen[order]]
        self.accepting = int((self.masks == 0).sum()) * width
        self.start = int(rank[group[0]]) * width
        stuck = [s for s in range(count) if self.masks[s] == 0 and (small[s] == s).all()]
        self.dead = stuck[0] * width if stuck else -1
        self.flat = self.table.tolist()
        self.class_list = classes.tolist()

    @property
    def states(self) -> int:
        return len(self.masks)

    def longest(self, raw: bytes, start: int) -> int:
        """End of the longest match at start, or -1."""
        state, end, flat, classes, dead, accepting = self.start, -1, self.flat, self.class_list, self.dead, self.accepting
        if state >= accepting:
            end = start
        for i in range(start, len(raw)):
            state = flat[state + classes[raw[i]]]
            if state == dead:
                break
            if state >= accepting:
                end = i + 1
        return end


#: Below so many texts still running, each is finished on its own.
FEW = 96


def scan_backward(dfa: Dfa, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, mask) of each place where a match of a rule begins. dfa reads backward and searches.

    All texts of the group advance together, one byte each a step, the longest
    first, so each step is a handful of array operations over the texts that
    still run; the last few long ones are finished one by one.
    """
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    by_length = lengths[order]
    ends = offsets[1:][order] - 1
    state = np.full(len(order), dfa.start, dtype=np.int32)
    classes = dfa.classes[data]
    table, accepting = dfa.table, dfa.accepting
    rows, places, states = [], [], []
    active = np.searchsorted(-by_length, -np.arange(int(by_length[0]) if len(by_length) else 0), side="left")
    step = 0
    for n in active.tolist():
        if n < FEW:
            break
        at = ends[:n] - step
        now = table[state[:n] + classes[at]]
        state[:n] = now
        hit = np.flatnonzero(now >= accepting)
        if len(hit):
            rows.append(order[hit])
            places.append(at[hit])
            states.append(now[hit])
        step += 1
    flat = dfa.flat
    for lane in range(int(active[step]) if step < len(active) else 0):
        row = int(order[lane])
        low, high = int(offsets[row]), int(ends[lane]) - step + 1
        s, found = int(state[lane]), []
        for i, c in enumerate(classes[low:high][::-1].tolist()):
            s = flat[s + c]
            if s >= accepting:
                found.append((high - 1 - i, s))
        if found:
            rows.append(np.full(len(found), row))
            places.append(np.array([f[0] for f in found], dtype=np.int64))
            states.append(np.array([f[1] for f in found], dtype=np.int32))
    if not rows:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    row = np.concatenate(rows)
    return row, np.concatenate(places) - offsets[row], dfa.masks[np.concatenate(states) // dfa.width]
