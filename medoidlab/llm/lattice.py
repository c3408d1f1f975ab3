"""Cheapest edits of a run of turns: the auction algorithm for shortest paths on a lattice.

A lattice node is (number of turns read, state); the states follow the role pattern
``(s?(ua)+)?``: 0 nothing yet, 1 after the system turn, 2 after a user, 3 after an
assistant. Arcs are the edits, with integer costs: Delete 3, Insert 2 (next role of the
pattern, no turn read), Keep 0, Rerole 2; Keep and Rerole of a truncated turn 1 more.

Every node has a price, at most the cost of any arc out of it plus the price at its end.
A path starts at an origin; if its last node's price is below its cheapest arc it is raised
to it and the path contracts by one node, else the path is extended along that arc, until
it reaches the sink; the origin's price is then its distance. Arcs whose cost equals the
drop in price are tight; the tight arcs that lead to the sink are exactly the optimal
edits, and following the label that is least in ASCII gives the least of the cheapest
edit strings. The lattice is cut into windows, settled from the last one backwards, so a
path never contracts over more than a window: time and memory grow with the turns.
"""

from __future__ import annotations

INITIALS = "suax"
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
#: One sign a turn: 4 * status + place of the role's initial.
SIGNS = "abcdefghijklmnop"

DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: The role that follows each state, and the state after it.
NEXT = ((2, "u"), (2, "u"), (3, "a"), (2, "u"))
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
UNREACHED = None
#: Costs at the end of a conversation: nothing at all or a last assistant turn.
END = (0, UNREACHED, UNREACHED, 0)
WINDOW = 16


def _arcs(sign: int, state: int) -> list[tuple[str, int, int]]:
    """(label, cost, state after) of the edits that read the turn ``sign``."""
    status, initial = sign >> 2, INITIALS[sign & 3]
    arcs = [(DELETE, COST[DELETE], state)]
    if status <= TRUNCATED:
        extra = int(status == TRUNCATED)
        if initial in KEPT[state]:
            arcs.append((KEEP, COST[KEEP] + extra, KEPT[state][initial]))
        arcs.append((REROLE, COST[REROLE] + extra, NEXT[state][0]))
    return arcs


_ARCS = [[_arcs(sign, state) for state in range(4)] for sign in range(16)]
_LEAST = [3 if s >> 2 >= BLANK else int(s >> 2 == TRUNCATED) for s in range(16)]


class Window:
    """The nodes of some turns, with the costs of leaving after the last of them."""

    def __init__(self, signs: list[int], exits, last: bool):
        n = len(signs)
        self.n, sink = n, 4 * (n + 1)
        self.floor = min(e for e in exits if e is not UNREACHED)
        self.out: list[list[tuple[str, int, int]]] = [[] for _ in range(sink + 1)]
        reach = [False] * sink + [True]
        self.price = [0] * (sink + 1)
        least = 0
        for i in range(n, -1, -1):
            if i < n:
                least += _LEAST[signs[i]]
            # Inserts lead from a lower to a higher state, or between 2 and 3: two sweeps
            # settle what can be reached.
            for _ in range(2):
                for q in (3, 2, 1, 0):
                    arcs = []
                    if i == n and exits[q] is not UNREACHED:
                        arcs.append(("", exits[q] - self.floor, sink))
                    if i < n:
                        arcs += [(a, c, 4 * (i + 1) + to) for a, c, to in _ARCS[signs[i]][q]]
                    if i < n or last:
                        arcs.append((INSERT, COST[INSERT], 4 * i + NEXT[q][0]))
                    arcs = [a for a in arcs if reach[a[2]]]
                    node = 4 * i + q
                    reach[node] = bool(arcs)
                    self.out[node] = sorted(arcs)
                    self.price[node] = least
        self.reach, self.sink = reach, sink
        for q in range(4):
            if reach[q]:
                self._settle(q)

    def _settle(self, origin: int) -> None:
        out, price, path = self.out, self.price, [origin]
        while path[-1] != self.sink:
            node = path[-1]
            best, to = min((c + price[j], j) for _, c, j in out[node])
            if best > price[node]:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)

    def entry(self) -> list[int | None]:
        """Cheapest cost from each state before the first turn."""
        return [self.price[q] + self.floor if self.reach[q] else UNREACHED for q in range(4)]

    def _tight(self) -> list[list[tuple[str, int]]]:
        """Per node the tight arcs (label, node) from which tight arcs lead to the sink."""
        good = [[] for _ in self.out]
        good[self.sink] = [("", self.sink)]
        for i in range(self.n, -1, -1):
            for _ in range(2):
                for q in (3, 2, 1, 0):
                    node = 4 * i + q
                    good[node] = [
                        (a, j) for a, c, j in self.out[node] if self.price[node] == c + self.price[j] and good[j]
                    ]
        return good

    def trace(self, state: int) -> tuple[list[str], int]:
        """Labels of the least cheapest edits from ``state``, and the state they end in."""
        good, node, labels = self._tight(), state, []
        while True:
            label, to = min(good[node])
            if to == self.sink:
                return labels, node % 4
            labels.append(label)
            node = to


class Block:
    """A run of turns as windows, settled from the last to the first."""

    def __init__(self, signs: str, exits=END, last: bool = True, width: int = WINDOW):
        codes = [SIGNS.index(s) for s in signs]
        self.codes, self.windows = codes, []
        end = len(codes)
        while True:
            start = max(0, end - width)
            self.windows.append(Window(codes[start:end], exits, last))
            exits, last, end = self.windows[-1].entry(), False, start
            if end == 0 or all(e is UNREACHED for e in exits):
                break
        self.windows.reverse()
        self.entry = exits

    def edits(self, state: int = 0) -> tuple[int, list[str], int]:
        """(cost, edits turn by turn, last state). A turn's edit is the roles inserted
        before it, then ``K``, ``D``, ``U`` or ``A`` (rerole); the last turn's also has the
        roles inserted after it."""
        cost, turns, pending, at, q = self.entry[state], [], "", 0, state
        for window in self.windows:
            labels, _ = window.trace(q)
            for label in labels:
                if label == INSERT:
                    q, role = NEXT[q]
                    pending += role
                    continue
                if label == REROLE:
                    q, role = NEXT[q]
                    label = role.upper()
                elif label == KEEP:
                    q = KEPT[q][INITIALS[self.codes[at] & 3]]
                turns.append(pending + label)
                pending, at = "", at + 1
        if pending:
            turns[-1] += pending
        return cost, turns, q


def transfer(signs: str) -> list[list[int | None]]:
    """Cheapest cost from each state before the turns to each state after them, with no
    insert after the last turn."""
    columns = [Block(signs, [0 if q == to else UNREACHED for q in range(4)], False).entry for to in range(4)]
    return [[columns[to][q] for to in range(4)] for q in range(4)]
