"""Cheapest repair of a run of turns: bidirectional Dijkstra over the edit lattice.

Turns are letters: ``s``, ``u``, ``a`` by their role's initial and ``o`` for any other, in
capitals if the text is cut off, and ``x`` for a turn that must go. Nodes are (turns used,
state); states follow what has been kept so far: nothing, a system turn, a user turn, an
assistant turn. Edits: Keep 0, Rerole 3, Delete 4, Insert 3, and 3 more for a cut-off turn that stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heappop, heappush

REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: A conversation may end before it began or behind an assistant.
ENDS = (START, ASSISTANT)
#: What the next user or assistant turn makes of each state, and which of the two it is.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = ("user", "user", "assistant", "user")


def _kept(state: int, initial: str) -> int | None:
    """The state behind a turn that is kept as it is."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if initial == ROLES[state][0] else None


def _steps(turns: str, i: int, state: int) -> Iterator[tuple[int, int, str, int]]:
    """Edges (turns used, state, letter, cost) out of a node."""
    yield i, NEXT[state], "I", INSERT
    if i < len(turns):
        yield i + 1, state, "D", DELETE
        turn = turns[i]
        if turn != "x":
            extra = CUT_OFF if turn.isupper() else 0
            yield i + 1, NEXT[state], "R", REROLE + extra
            kept = _kept(state, turn.lower())
            if kept is not None:
                yield i + 1, kept, "K", extra


def _steps_back(turns: str, i: int, state: int) -> Iterator[tuple[int, int, str, int]]:
    """Edges into a node, by the node they come from."""
    for before in range(4):
        if NEXT[before] == state:
            yield i, before, "I", INSERT
    if i:
        yield i - 1, state, "D", DELETE
        turn = turns[i - 1]
        if turn != "x":
            extra = CUT_OFF if turn.isupper() else 0
            for before in range(4):
                if NEXT[before] == state:
                    yield i - 1, before, "R", REROLE + extra
                if _kept(before, turn.lower()) == state:
                    yield i - 1, before, "K", extra


class _Side:
    """One direction: a heap, and per node the least cost and the least audit of that cost.

    Only Keep is free, and it uses a turn, so nodes of equal cost leave the heap in the order
    of the turns used: by then each has met every path of its cost.
    """

    def __init__(self, starts: Sequence[tuple[int, int]], sign: int) -> None:
        self.cost = dict.fromkeys(starts, 0)
        self.audit = dict.fromkeys(starts, "")
        self.sign = sign
        self.done: set[tuple[int, int]] = set()
        self.heap = [(0, sign * i, state) for i, state in sorted(starts, key=lambda n: (sign * n[0], n[1]))]

    def top(self) -> float:
        while self.heap and (self.sign * self.heap[0][1], self.heap[0][2]) in self.done:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else math.inf

    def pop(self) -> tuple[int, int]:
        _, i, state = heappop(self.heap)
        node = (self.sign * i, state)
        self.done.add(node)
        return node

    def offer(self, node: tuple[int, int], cost: int, audit: str) -> None:
        known = self.cost.get(node, math.inf)
        if cost < known:
            heappush(self.heap, (cost, self.sign * node[0], node[1]))
        elif cost > known or audit >= self.audit[node]:
            return
        self.cost[node], self.audit[node] = cost, audit


def search(turns: str, entry: int, exits: Sequence[int]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest way through all turns from ``entry`` to one of ``exits``.

    Of equal costs, the audit that is least in ASCII. The searches stop once no crossing
    can be as cheap as the best, so that every crossing of the best cost is there to choose
    from. An audit can't begin with another of the same cost for the same turns (the longer
    would only add inserts), so the least parts give the least whole.
    """
    ahead, back = _Side([(0, entry)], 1), _Side([(len(turns), state) for state in exits], -1)
    best = 0 if not turns and entry in exits else math.inf
    while (low := ahead.top()) + (high := back.top()) <= best and math.isfinite(min(low, high)):
        if high <= low:
            i, state = node = back.pop()
            cost, audit = back.cost[node], back.audit[node]
            for j, other, letter, price in _steps_back(turns, i, state):
                if (j, other) not in back.done:
                    back.offer((j, other), cost + price, letter + audit)
                if (j, other) in ahead.cost:
                    best = min(best, ahead.cost[j, other] + price + cost)
        else:
            i, state = node = ahead.pop()
            cost, audit = ahead.cost[node], ahead.audit[node]
            for j, other, letter, price in _steps(turns, i, state):
                if (j, other) not in ahead.done:
                    ahead.offer((j, other), cost + price, audit + letter)
                if (j, other) in back.cost:
                    best = min(best, cost + price + back.cost[j, other])
    if not math.isfinite(best):
        return None
    # A way may also lie on one side from end to end.
    crossings = [back.audit[node] for node in back.done if node == (0, entry) and back.cost[node] == best]
    crossings += [ahead.audit[node] for node in ahead.done if node[0] == len(turns) and node[1] in exits and ahead.cost[node] == best]
    crossings += [
        ahead.audit[node] + letter + back.audit[j, other]
        for node in ahead.done
        for j, other, letter, price in _steps(turns, *node)
        if (j, other) in back.done and ahead.cost[node] + price + back.cost[j, other] == best
    ]
    return int(best), min(crossings)


@lru_cache(maxsize=50_000)
def whole(turns: str) -> tuple[int, str]:
    """The repair of a conversation that is in one piece."""
    return search(turns, START, ENDS)


def through(turns: str) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) for every way through one piece of a conversation."""
    found = ((entry, to, search(turns, entry, (to,))) for entry in range(4) for to in range(4))
    return [(entry, to, *best) for entry, to, best in found if best]


class Joined:
    """Pieces of a conversation joined one after the other, with the best way to each state.

    Ways are kept as (way before, audit of the piece), so joining costs the length of a piece;
    ways of equal cost are compared back to where they part.
    """

    def __init__(self) -> None:
        self.ways: dict[int, tuple[int, tuple | None]] = {START: (0, None)}

    @staticmethod
    def _less(x: tuple, y: tuple) -> bool:
        ends: tuple[list[str], list[str]] = ([], [])
        while x is not y:
            for way, parts in zip((x, y), ends):
                parts.append(way[1])
            x, y = x[0], y[0]
        return "".join(reversed(ends[0])) < "".join(reversed(ends[1]))

    def join(self, piece: list[tuple[int, int, int, str]]) -> None:
        ways: dict[int, tuple[int, tuple | None]] = {}
        for entry, to, cost, audit in piece:
            if entry in self.ways:
                total, before = self.ways[entry][0] + cost, self.ways[entry][1]
                way = (before, audit)
                if to not in ways or total < ways[to][0] or (total == ways[to][0] and self._less(way, ways[to][1])):
                    ways[to] = total, way
        self.ways = ways

    def best(self) -> tuple[int, str]:
        least = min(cost for state, (cost, _) in self.ways.items() if state in ENDS)
        audits = []
        for state in ENDS:
            if state in self.ways and self.ways[state][0] == least:
                parts, way = [], self.ways[state][1]
                while way is not None:
                    parts.append(way[1])
                    way = way[0]
                audits.append("".join(reversed(parts)))
        return least, min(audits)
