"""Rule expressions over bytes compiled to one minimal deterministic automaton.

Supported: literals, escapes (``\\xHH``, ``\\n``, ``\\t``, ``\\.`` and so on), classes, groups, ``|``, ``?``, ``*``, ``+``, ``{m}``,
``{m,}``, ``{m,n}`` and, for a group, ``(?i:...)``. That is what span rules need; anchors and
back-references are not in it.
"""

from __future__ import annotations

import numpy as np


class Rules:
    """A nondeterministic automaton for several rules, in two directions: forward with any text
    allowed before a match, or backward."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []   # state to (bytes, next state)
        self.skips: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([]), self.skips.append([])
        return len(self.moves) - 1

    def add(self, node, start: int, backward: bool) -> int:
        """Lay ``node`` from ``start`` on; returns the state where it ends."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "all":
            for part in reversed(node[1]) if backward else node[1]:
                start = self.add(part, start, backward)
            return start
        if kind == "any":
            end = self.state()
            for part in node[1]:
                self.skips[self.add(part, self.branch(start), backward)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            start = self.add(part, start, backward)
        if most is None:
            loop = self.branch(start)
            self.skips[self.add(part, loop, backward)].append(loop)
            return loop
        end = self.state()
        self.skips[start].append(end)
        for _ in range(most - least):
            start = self.add(part, self.branch(start), backward)
            self.skips[start].append(end)
        return end

    def branch(self, start: int) -> int:
        state = self.state()
        self.skips[start].append(state)
        return state


def parsed(pattern: str):
    """Syntax tree of a rule expression."""
    at = 0

    def peek():
        return pattern[at] if at < len(pattern) else ""

    def take():
        nonlocal at
        at += 1
        return pattern[at - 1]

    def escape():
        c = take()
        if c == "x":
            return int(take() + take(), 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def either_case(codes, fold):
        return frozenset(codes) | (frozenset(ord(chr(c).swapcase()) for c in codes if chr(c).isascii() and chr(c).isalpha()) if fold else frozenset())

    def members(fold):
        negated, codes = peek() == "^" and bool(take()), set()
        while peek() != "]":
            low = escape() if (c := take()) == "\\" else ord(c)
            if peek() == "-" and pattern[at + 1:at + 2] != "]":
                take()
                high = escape() if (c := take()) == "\\" else ord(c)
                codes.update(range(low, high + 1))
            else:
                codes.add(low)
        take()
        return either_case(set(range(256)) - codes if negated else codes, fold)

    def atom(fold):
        c = take()
        if c == "(":
            inner = fold
            if pattern.startswith("?i:", at):
                inner = True
                for _ in "?i:":
                    take()
            elif pattern.startswith("?:", at):
                take(), take()
            node = choice(inner)
            if not peek():
                raise ValueError(f"open group in {pattern!r}")
            take()
            return node
        if c == "[":
            return ("set", members(fold))
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        if c in "*+?{|)^$":
            raise ValueError(f"{c!r} at {at} in {pattern!r}")
        return ("set", either_case({escape() if c == "\\" else ord(c)}, fold))

    def repeated(fold):
        node = atom(fold)
        while peek() and peek() in "*+?{":
            c = take()
            if c == "{":
                text = ""
                while peek() != "}":
                    text += take()
                take()
                low, _, high = text.partition(",")
                node = ("repeat", node, int(low), (int(high) if high else None) if "," in text else int(low))
            else:
                node = ("repeat", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def choice(fold):
        parts = [[]]
        while peek() and peek() != ")":
            if peek() == "|":
                take()
                parts.append([])
            else:
                parts[-1].append(repeated(fold))
        nodes = [("all", p) for p in parts]
        return nodes[0] if len(nodes) == 1 else ("any", nodes)

    tree = choice(False)
    if at < len(pattern):
        raise ValueError(f"unmatched ) in {pattern!r}")
    return tree


def compiled(patterns: list[str], *, search: bool = False, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(transitions, accepted): states x 256 next states, and a bit mask of rules per state. State 0 is
    dead, state 1 the start. With ``search`` a match may begin anywhere."""
    nfa = Rules()
    start = nfa.state()
    if search:
        nfa.moves[start].append((frozenset(range(256)), start))
    ends = {}
    for rule, pattern in enumerate(patterns):
        end = nfa.add(parsed(pattern), nfa.branch(start), backward)
        ends[end] = ends.get(end, 0) | 1 << rule

    def closed(states):
        seen, todo = set(states), list(states)
        while todo:
            for s in nfa.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s), todo.append(s)
        return frozenset(seen)

    first = closed([start])
    numbers, rows, masks, todo = {frozenset(): 0, first: 1}, [np.zeros(256, np.int32)], [0], [first]
    while todo:
        subset = todo.pop(0)
        masks.append(sum(ends[s] for s in subset if s in ends))
        targets = [set() for _ in range(256)]
        for s in subset:
            for codes, to in nfa.moves[s]:
                for code in codes:
                    targets[code].add(to)
        row, known = np.zeros(256, np.int32), {}
        for code, to in enumerate(map(frozenset, targets)):
            if to not in known:
                reached = closed(to)
                if reached not in numbers:
                    numbers[reached] = len(numbers)
                    todo.append(reached)
                known[to] = numbers[reached]
            row[code] = known[to]
        rows.append(row)
    return minimised(np.array(rows), np.array(masks))


def minimised(moves: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that accept alike and lead to alike states, by refining classes until stable."""
    classes = np.unique(masks, return_inverse=True)[1]
    while True:
        keys = np.column_stack([classes, classes[moves]])
        refined = np.unique(keys, axis=0, return_inverse=True)[1].ravel()
        if refined.max() == classes.max():
            break
        classes = refined
    order = np.full(refined.max() + 1, -1)
    for state in range(len(moves)):     # the dead state and the start keep their numbers
        if order[refined[state]] < 0:
            order[refined[state]] = order.max() + 1
    if order[refined[1]] == 0:          # the start itself is dead
        return np.zeros((2, 256), np.int32), np.zeros(2, np.int64)
    size = order.max() + 1
    table, accepted = np.zeros((size, 256), np.int32), np.zeros(size, np.int64)
    table[order[refined]] = order[refined[moves]]
    accepted[order[refined]] = masks
    return table, accepted
