"""Deterministic automata over bytes, built from rule patterns: parse, positions, subset construction, minimisation.

Patterns know bytes, classes, groups, `|`, `?`, `*`, `+`, `{m}`, `{m,}`, `{m,n}` and the escapes \\xHH, \\d, \\w and escaped signs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_DIGITS = frozenset(range(48, 58))
_WORDS = _DIGITS | frozenset(range(65, 91)) | frozenset(range(97, 123)) | {95}
_ANY = frozenset(range(256)) - {10}
#: A state's rules are the bits of one number.
MOST_RULES = 64


class _Parser:
    """Patterns to trees: ("set", bytes), ("cat", parts), ("or", parts), ("rep", part, least, most or None)."""

    def __init__(self, pattern: str, fold: bool):
        self.text, self.at, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def whole(self):
        tree = self.choice()
        if self.peek():
            raise ValueError(f"unexpected {self.peek()!r} at {self.at} of {self.text!r}")
        return tree

    def choice(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        part = self.atom()
        while (sign := self.peek()) and sign in "?*+{":
            self.take()
            if sign == "{":
                body = ""
                while self.peek() != "}":
                    body += self.take()
                self.take()
                least, comma, most = body.partition(",")
                bounds = (int(least), int(most) if most else None if comma else int(least))
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
            part = ("rep", part, *bounds)
        return part

    def atom(self):
        sign = self.take()
        if sign == "(":
            tree = self.choice()
            if self.take() != ")":
                raise ValueError("a group is not closed")
            return tree
        if sign == "[":
            return ("set", self.folded(self.bracket()))
        if sign == ".":
            return ("set", _ANY)
        return ("set", self.folded(self.escape() if sign == "\\" else frozenset(sign.encode())))

    def escape(self) -> frozenset:
        sign = self.take()
        if sign == "x":
            return frozenset([int(self.take() + self.take(), 16)])
        return {"d": _DIGITS, "w": _WORDS, "n": frozenset([10]), "t": frozenset([9])}.get(sign, frozenset(sign.encode()))

    def bracket(self) -> frozenset:
        out, inverse = set(), self.peek() == "^"
        if inverse:
            self.take()
        while self.peek() != "]":
            low = self.escape() if self.take() == "\\" else frozenset(self.text[self.at - 1].encode())
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                high = self.escape() if self.take() == "\\" else frozenset(self.text[self.at - 1].encode())
                low = frozenset(range(min(low), max(high) + 1))
            out |= low
        self.take()
        return frozenset(range(256)) - out if inverse else frozenset(out)

    def folded(self, own: frozenset) -> frozenset:
        if not self.fold:
            return own
        letters = {b for b in own if chr(b).isascii() and chr(b).isalpha()}
        return own | {b ^ 32 for b in letters}


def _first_end(tree):
    """The tree without what its matches may go on with: where it ends first."""
    if tree[0] == "rep":
        return ("rep", tree[1], tree[2], tree[2])
    return ("cat", [*tree[1][:-1], _first_end(tree[1][-1])]) if tree[0] == "cat" and tree[1] else tree


def _reverse(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", _reverse(tree[1]), *tree[2:])
    parts = [_reverse(x) for x in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class _Nfa:
    """Thompson's construction; arcs: (bytes, state), free: moves without a byte."""

    def __init__(self):
        self.arcs: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def add(self, tree, at: int) -> int:
        """Lets the tree begin in this state and returns the one in which it ends."""
        if tree[0] == "set":
            end = self.state()
            self.arcs[at].append((tree[1], end))
            return end
        if tree[0] == "cat":
            for part in tree[1]:
                at = self.add(part, at)
            return at
        if tree[0] == "or":
            end = self.state()
            for part in tree[1]:
                self.free[self.add(part, at)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            at = self.add(part, at)
        end = self.state()
        self.free[at].append(end)
        if most is None:
            loop = self.state()
            self.free[at].append(loop)
            back = self.add(part, loop)
            self.free[back] += [loop, end]
        for _ in range((most or 0) - least if most is not None else 0):
            at = self.add(part, at)
            self.free[at].append(end)
        return end

    def closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass(frozen=True)
class Dfa:
    """move[state, kind of byte] is the next state, accept[state] the bits of the rules that end there; state 0 is the start."""

    kinds: np.ndarray
    move: np.ndarray
    accept: np.ndarray
    dead: int  # the state that nothing leaves and that accepts nothing, or -1

    @staticmethod
    def of(trees: list, anywhere: bool) -> Dfa:
        """anywhere: a match may begin at any byte."""
        if len(trees) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules in one automaton")
        nfa = _Nfa()
        start = nfa.state()
        if anywhere:
            nfa.arcs[start].append((frozenset(range(256)), start))
        ends: dict[int, int] = {}
        for bit, tree in enumerate(trees):
            begin = nfa.state()
            nfa.free[start].append(begin)
            ends[nfa.add(tree, begin)] = 1 << bit
        # bytes that no arc tells apart are one kind
        signs = sorted({s for arcs in nfa.arcs for s, _ in arcs}, key=sorted)
        keys = [tuple(b in s for s in signs) for b in range(256)]
        number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        kinds = np.array([number[k] for k in keys], np.uint8)
        sample = [keys.index(k) for k in number]
        moves = [[(frozenset(k for k, b in enumerate(sample) if b in s), t) for s, t in arcs] for arcs in nfa.arcs]
        first = nfa.closed([start])
        index, order, rows = {first: 0}, [first], []
        for own in order:
            to = [set() for _ in sample]
            for s in own:
                for ks, t in moves[s]:
                    for k in ks:
                        to[k].add(t)
            row = []
            for t in to:
                target = nfa.closed(t)
                if target not in index:
                    index[target] = len(order)
                    order.append(target)
                row.append(index[target])
            rows.append(row)
        accept = np.array([sum({ends[s] for s in own if s in ends}) for own in order], np.uint64)
        return Dfa._least(kinds, np.array(rows, np.int32), accept)

    @staticmethod
    def _least(kinds: np.ndarray, move: np.ndarray, accept: np.ndarray) -> Dfa:
        """Merges states that nothing tells apart, by refining classes until they hold."""
        _, part = np.unique(accept, return_inverse=True)
        while True:
            _, new = np.unique(np.column_stack([part, part[move]]), axis=0, return_inverse=True)
            new = new.reshape(-1)
            if new.max() == part.max():
                break
            part = new
        order = {}
        for p in part.tolist():  # the start stays state 0
            order.setdefault(p, len(order))
        name = np.array([order[p] for p in part.tolist()])
        out, ends = np.zeros((len(order), move.shape[1]), np.int32), np.zeros(len(order), np.uint64)
        out[name], ends[name] = name[move], accept
        idle = [s for s in range(len(out)) if not ends[s] and (out[s] == s).all()]
        return Dfa(kinds, out, ends, idle[0] if idle else -1)

    def longest(self, data: bytes, places: range) -> int:
        """How many of the bytes at these places, read in this order, the longest match takes; -1 without a match."""
        state, best = 0, 0 if self.accept[0] else -1
        move, kinds, accept, dead = self.move, self.kinds, self.accept, self.dead
        for n, at in enumerate(places, 1):
            state = move[state, kinds[data[at]]]
            if state == dead:
                break
            if accept[state]:
                best = n
        return best


    def holds_itself(self) -> bool:
        """Whether a first match may hold another one that begins after its first byte and ends before its last."""
        # of the inner match: -1 not begun, -2 ended, else its state
        start = (0, -1, False)
        seen, todo = {start}, [start]
        while todo:
            outer, inner, begun = todo.pop()
            if self.accept[outer]:
                continue
            for kind in range(self.move.shape[1]):
                new = int(self.move[outer, kind])
                if new == self.dead:
                    continue
                after = []
                if inner == -2:
                    if self.accept[new]:
                        return True
                    after = [-2]
                elif inner == -1:
                    after = [-1] + ([int(self.move[0, kind])] if begun else [])
                else:
                    after = [int(self.move[inner, kind])]
                for own in after:
                    if own >= 0 and self.accept[own]:
                        own = -2
                    if own == self.dead and own >= 0:
                        continue
                    state = (new, own, True)
                    if state not in seen:
                        seen.add(state)
                        todo.append(state)
        return False


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    fold: bool = False  # letters in either case


class Scanner:
    """All rules in one automaton that marks where matches first end; automata of each rule give a match's start and its end.

    A match is leftmost and as long as can be. Of two matches of a rule, the one that starts first must also be the one that first
    ends first; this holds for rules whose parts before a last repeated class cannot contain one another.
    """

    #: A sentinel that no rule holds, put between texts.
    BREAK = 10

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        trees = [_Parser(r.pattern, r.fold).whole() for r in rules]
        first = [_first_end(t) for t in trees]
        self.ends = Dfa.of(first, anywhere=True)
        self.back = [Dfa.of([_reverse(t)], anywhere=False) for t in first]
        self.on = [Dfa.of([t], anywhere=False) for t in trees]
        for rule, tree in zip(rules, first, strict=True):
            if Dfa.of([tree], anywhere=False).holds_itself():
                raise ValueError(f"a match of {rule.kind!r} may begin later and end before another one")
        same = (self.ends.move == self.ends.move[:1]).all(0)  # kinds that lead to one state from everywhere
        self.resets = same[self.ends.kinds]
        if not self.resets[self.BREAK]:
            raise ValueError("a rule crosses line ends")

    def accepts(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions after which some rule may end, with the rules' bits. breaks: where texts begin.

        One pass: the bytes are cut into lanes, each of which begins after a byte that leads to the same state from any state, and all
        lanes step together.
        """
        n = len(data)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        kinds, move, accept = self.ends.kinds, self.ends.move.reshape(-1).astype(np.int32), self.ends.accept
        width = self.ends.move.shape[1]
        size = max(256, n // 16384)
        wanted = np.arange(size, n, size)
        reset = np.flatnonzero(self.resets[data]) + 1
        at = np.searchsorted(reset, wanted)
        lanes = np.unique(np.concatenate([[0], breaks[breaks < n], reset[at[at < len(reset)]]]))
        lanes = lanes[lanes < n]
        length = np.diff(np.concatenate([lanes, [n]]))
        # a lane after a reset starts as that byte leaves it, one at a text's start in state 0
        state = np.zeros(len(lanes), np.int32)
        inside = ~np.isin(lanes, breaks) & (lanes > 0)
        state[inside] = self.ends.move[0, kinds[data[lanes[inside] - 1]]]
        by = np.argsort(-length, kind="stable")
        lanes, length, state = lanes[by], length[by], state[by]
        live = np.searchsorted(-length, -np.arange(length[0]), "left")  # lanes with more bytes than the step
        places, bits = [], []
        for step in range(int(length[0])):
            k = live[step]
            where = lanes[:k] + step
            new = move[state[:k] * width + kinds[data[where]]]
            state[:k] = new
            hit = accept[new]
            if hit.any():
                on = np.flatnonzero(hit)
                places.append(where[on] + 1)
                bits.append(hit[on])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        places, bits = np.concatenate(places), np.concatenate(bits)
        order = np.argsort(places, kind="stable")
        return places[order], bits[order]

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Of each text its matches as (rule, start, end) in bytes of the text, leftmost and not overlapping for each rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        places, bits = self.accepts(data, offsets[:-1])
        # an empty text shares its start with the next one; the last of equal starts holds the byte
        text = np.searchsorted(offsets[:-1], places - 1, "right") - 1
        raw: dict[int, bytes] = {}
        for rule in range(len(self.rules)):
            own = np.flatnonzero(bits >> np.uint64(rule) & np.uint64(1))
            past, before = -1, 0
            for place, i in zip(places[own].tolist(), text[own].tolist(), strict=True):
                begin = int(offsets[i])
                if i != past:
                    past, before = i, 0
                    if i not in raw:
                        raw[i] = data[begin : int(offsets[i + 1])].tobytes()
                place -= begin
                if place <= before:
                    continue
                back = self.back[rule].longest(raw[i], range(place - 1, before - 1, -1))
                if back > 0:
                    start = place - back
                    before = start + self.on[rule].longest(raw[i], range(start, len(raw[i])))
                    out[i].append((rule, start, before))
        return out
