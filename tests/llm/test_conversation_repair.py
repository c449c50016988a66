"""Conversation repair against a plain search over all edit sequences, by cost and then by audit."""
import hashlib
import heapq
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revtrace.llm import auction, conversation_repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, code string, place long"


def cheapest(rows):
    """rows: (initial, must go, cut off). The least (cost, audit) by a queue over (rows done, state)."""
    queue, done = [(0, "", 0, "")], set()
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        heapq.heappush(queue, (cost + 5, audit + "I", i, turn[state]))
        if i < len(rows):
            initial, gone, cut = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state))
            if not gone:
                if (state, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    heapq.heappush(queue, (cost + 5 * cut, audit + "K", i + 1, initial))
                heapq.heappush(queue, (cost + 1 + 5 * cut, audit + "R", i + 1, turn[state]))


def plain(table):
    convs = {}
    for conv, turn, role, text in table:
        out = convs.setdefault(conv, [])
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    result = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            end = text.rstrip(SPACE)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in rows]
        bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)])
        lines, at, state = [], 0, ""
        for e in audit:
            new = "a" if state == "u" else "u"
            if e in "DKR":
                _, role, text = rows[at]
                at += 1
            if e == "D":
                continue
            if e == "K":
                lines.append(f"{role}:{text}")
                state = role[0]
            else:
                lines.append({"u": "user", "a": "assistant"}[new] + ":" + (text if e == "R" else ""))
                state = new
        result.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(result, key=str)


def run(spark, table):
    rows = [(*r, "c", i) for i, r in enumerate(table)]
    got = conversation_repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    return sorted(map(tuple, got), key=str)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="suaoSUAO1234", max_size=14), st.integers(1, 6))
def test_auction_equals_search(code, piece):
    auction.PIECE, before = piece, auction.PIECE
    try:
        rows = [(c.translate(auction.ROLES), c in "1234", c in "SUAO") for c in code]
        cost, audit = cheapest(rows)
        assert auction.trace(code, 0, auction.END, True)[::2] == (audit, cost)
        assert auction.behind(auction.matrix_of(code), auction.END_CLOSED)[0] == cost
    finally:
        auction.PIECE = before


def test_prices_are_dual_feasible():
    code = "sU1ao2uaSAu" * 5
    arcs, prices, sink = auction.lattice(code, auction.END, True)
    cost = auction.auction(arcs, prices, 0, sink)
    assert all(prices[n] <= c + prices[to] for n, out in enumerate(arcs) for _, c, to in out if prices[n] < auction.INF)
    assert cost == cheapest([(c.translate(auction.ROLES), c in "1234", c in "SUAO") for c in code])[0] == prices[0] - prices[sink]


def made(seed, convs, longest):
    rng = random.Random(seed)
    table = []
    for conv in convs:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant", "user", "assistant"])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \t", None, f"Turn {turn}.", f"open {turn}", "é?", "漢。", "Ends. \n"])
            table.append((conv, None if rng.random() < 0.05 else turn + (turn > 9) * 3, role, text))
            if rng.random() < 0.1:
                table.append(table[-1])
    return table


@pytest.mark.parametrize("bits", [10, 2])
def test_table(spark, monkeypatch, bits):
    monkeypatch.setattr(conversation_repair, "CHUNK_BITS", bits)
    table = made(1, [*range(120), None], 12) + [(500, None, "user", "Only null turns."), (501, 7, "assistant", "x" * 200_000)]
    table += [r for c in range(600, 620) for r in ((c, 0, "user", "Yes."), (c, 1, "assistant", "No!"))] + [(c, 0, "user", "One.") for c in range(700, 740)]
    got = run(spark, table)
    assert got == plain(table) and any(r[6] == 0 for r in got) and any(not r[7] for r in got)


@pytest.mark.parametrize("bits", [10, 4])
def test_one_conversation_holds_most_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(conversation_repair, "CHUNK_BITS", bits)
    table = made(2, range(40), 5) + [(7, t, "user" if t % 2 == 0 else "assistant", f"Text {t % 50}." if t % 3 else f"text {t}") for t in range(3000)]
    assert run(spark, table) == plain(table)


def test_empty_table(spark):
    assert run(spark, []) == []
