"""Cheapest repair of a role sequence by the auction algorithm for shortest paths.

A row is a letter: s, u, a, o (role initial system, user, assistant, other); upper case: its text is cut off; 1, 2, 3, 4 for s, u, a, o:
the row has to go. Nodes of the lattice are (rows done, state of the role pattern `(s?(ua)+)?`); arcs are edits with integer costs.
From the origin a path is extended along arcs that are tight (price = cost + price behind) and contracted where none is, with the
price raised to the least. All cycles (of inserts) cost something, so it ends; prices then are a dual solution, and every cheapest path
runs along tight arcs. Of those that lead to the end, the path with the least labels is traced.

A long sequence is cut into pieces: the costs between all entry and exit states of a piece form a matrix, matrices are combined by
(min, +), and each piece is traced with the costs behind it as the price of its exits.
"""
from __future__ import annotations

from functools import lru_cache

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # where a user or assistant row leads
DELETE_COST, REROLE_COST, INSERT_COST, CUT_OFF_COST = 2, 1, 5, 5
INF = 1 << 40
END = (0, INF, INF, 0)  # a sequence may end in these states
END_CLOSED = (0, 2 * INSERT_COST, INSERT_COST, 0)  # the same with inserts at the end
PIECE = 64
ROLES = str.maketrans("SUAO1234", "suaosuao")

Arcs = list[list[tuple[str, int, int]]]  # by node: (label, cost, next node)


def row_edits(letter: str) -> list[list[tuple[str, int, int]]]:
    """By state: (label, cost, next state) of the edits that use up the row."""
    edits = [[("D", DELETE_COST, state)] for state in range(4)]
    if letter not in "1234":
        more = CUT_OFF_COST if letter.isupper() else 0
        for state, after in KEEP[letter.lower()].items():
            edits[state].append(("K", more, after))
        for state, after in TURN.items():
            edits[state].append(("R", more + REROLE_COST, after))
    return edits


EDITS = {letter: row_edits(letter) for letter in "suaoSUAO1234"}
LEAST = {letter: min(cost for edits in by_state for _, cost, _ in edits) for letter, by_state in EDITS.items()}


def lattice(code: str, exits: tuple, last: bool) -> tuple[Arcs, list[int], int]:
    """(arcs, first prices, sink). exits: cost from each exit state to the end of all; last: rows may be inserted at the end.

    First prices: what the rows to come cost at least, so price <= cost + price behind on every arc. A node from which the end
    cannot be reached has price INF and no arc leads to it.
    """
    n, sink = len(code), 4 * len(code) + 4
    arcs: Arcs = [[] for _ in range(sink + 1)]
    prices = [INF] * sink + [0]
    floor = min(exits)
    for i in range(n, -1, -1):
        if i < n:
            floor += LEAST[code[i]]
        for state in range(4):
            node = 4 * i + state
            if i < n:
                arcs[node] = [(label, cost, 4 * i + 4 + to) for label, cost, to in EDITS[code[i]][state] if prices[4 * i + 4 + to] < INF]
            elif exits[state] < INF:
                arcs[node] = [("", exits[state], sink)]
            if arcs[node]:
                prices[node] = floor
        if i < n or last:
            for state in (USER, ASSISTANT, USER, START, SYSTEM):  # each may be reached by inserts only
                if prices[4 * i + TURN[state]] < INF:
                    prices[4 * i + state] = floor
            for state, to in TURN.items():
                if prices[4 * i + to] < INF:
                    arcs[4 * i + state].append(("I", INSERT_COST, 4 * i + to))
    return arcs, prices, sink


def auction(arcs: Arcs, prices: list[int], origin: int, sink: int) -> int:
    """Cost of the cheapest path; raises prices in place, which stay feasible for the next origin."""
    if prices[origin] >= INF:
        return INF
    path = [origin]
    while path[-1] != sink:
        node = path[-1]
        least, to = min((cost + prices[to], to) for _, cost, to in arcs[node])
        if prices[node] < least:
            prices[node] = least
            if node != origin:
                path.pop()
        else:
            path.append(to)
    return prices[origin]


def least_labels(arcs: Arcs, prices: list[int], origin: int, sink: int) -> tuple[str, int]:
    """(labels, node before the sink) of the ASCII-least path along tight arcs."""
    tight = [[a for a in out if prices[node] == a[1] + prices[a[2]]] for node, out in enumerate(arcs)]
    ahead = [False] * sink + [True]
    for layer in range(sink - 4, -1, -4):
        for state in (ASSISTANT, USER, ASSISTANT, USER, START, SYSTEM):
            ahead[layer + state] = any(ahead[to] for _, _, to in tight[layer + state])
    labels, node = [], origin
    while True:
        label, _, to = min(a for a in tight[node] if ahead[a[2]])
        if to == sink:
            return "".join(labels), node
        labels.append(label)
        node = to


def pieces(code: str) -> list[str]:
    return [code[i:i + PIECE] for i in range(0, len(code), PIECE)] or [""]


@lru_cache(4096)
def piece_matrix(code: str) -> tuple:
    """Cheapest cost from each entry state to each exit state of a piece, without inserts after its last row."""
    columns = []
    for state in range(4):
        arcs, prices, sink = lattice(code, tuple(0 if s == state else INF for s in range(4)), False)
        columns.append([auction(arcs, prices, entry, sink) for entry in range(4)])
    return tuple(zip(*columns))


def behind(matrix: tuple, exits: tuple) -> tuple:
    """Cost to the end from each entry state."""
    return tuple(min(INF, min(a + b for a, b in zip(row, exits))) for row in matrix)


def matrix_of(code: str) -> tuple:
    total = None
    for piece in pieces(code):
        m = piece_matrix(piece)
        total = m if total is None else tuple(tuple(min(INF, min(row[k] + m[k][j] for k in range(4))) for j in range(4)) for row in total)
    return total


@lru_cache(16384)
def trace_piece(code: str, entry: int, exits: tuple, last: bool) -> tuple[str, int, int]:
    """(audit, exit state, cost within the piece)."""
    arcs, prices, sink = lattice(code, exits, last)
    cost = auction(arcs, prices, entry, sink)
    if cost >= INF:
        return "", entry, INF
    audit, node = least_labels(arcs, prices, entry, sink)
    return audit, node - 4 * len(code), cost - exits[node - 4 * len(code)]


def trace(code: str, entry: int, exits: tuple, last: bool) -> tuple[str, int, int]:
    """The cheapest, then ASCII-least edits of a sequence from an entry state: (audit, exit state, cost). INF: no way."""
    parts = pieces(code)
    after = [exits]
    for part in parts[:0:-1]:
        after.append(behind(piece_matrix(part), END_CLOSED if last and len(after) == 1 else after[-1]))
    audit, total = [], 0
    for k, part in enumerate(parts):
        labels, entry, cost = trace_piece(part, entry, after[-1 - k], last and k == len(parts) - 1)
        if cost >= INF:
            return "", entry, INF
        audit.append(labels)
        total += cost
    return "".join(audit), entry, total


def illegal(code: str) -> int:
    """Adjacent role initials other than su, ua, au."""
    roles = code.translate(ROLES)
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(roles, roles[1:])))
