"""Turn repair against a plain dynamic programme, over blocks of any size, and on odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from quire.llm import auction, turn_repair

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        yield from [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)


def cheapest(turns):
    """(cost, audit, lines) of the best edits of (role, text, must go, cut)."""
    def better(to, state, found):
        if state not in to or found[:2] < to[state][:2]:
            to[state] = found

    def inserts(at):
        for _ in range(3):
            for state, (cost, audit, lines) in list(at.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in NEXT:
                        better(at, NEXT[state, role[0]], (cost + 3, audit + "I", [*lines, role + ":"]))
        return at

    at = inserts({"": (0, "", [])})
    for role, text, must, cut in turns:
        to = {}
        for state, (cost, audit, lines) in at.items():
            better(to, state, (cost + 4, audit + "D", lines))
            if must:
                continue
            more = 3 if cut else 0
            if (state, role[:1]) in NEXT:
                better(to, NEXT[state, role[:1]], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            for new in ("user", "assistant"):
                if (state, new[0]) in NEXT:
                    better(to, NEXT[state, new[0]], (cost + more + 3, audit + "R", [*lines, f"{new}:{text}"]))
        at = inserts(to)
    return min(at[s] for s in ("", "a") if s in at)


def brute(rows):
    out = {}
    hurt = list(damaged(rows))
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in hurt if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns, seen, counts = [], set(), [0, 0, 0]
        for _, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            seen.add((role, text))
            turns.append((role, text, fault in (0, 1), fault == 2))
        numbers = [r[0] for r in mine if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = cheapest(turns)
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def result(df):
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def made_up(seed, n, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", "User", None])
            text = rng.choice(["Yes.", "No", " ", "", None, "Well?\n", "same.", f"own {turn}.", f"cut {turn}", "é…"])
            rows += [(conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


def test_made_up_conversations(spark):
    rows = made_up(1, 60, 14)
    assert result(turn_repair.report(table(spark, rows))) == brute(rows)


@pytest.mark.parametrize("block", [1, 2, 5])
def test_conversations_over_many_blocks(spark, monkeypatch, block):
    """Blocks hold few turns, so that prices and states pass between them, over partition borders too."""
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rows = made_up(2, 12, 60)
    monkeypatch.setattr(turn_repair, "_blocks", _with_block(block, turn_repair._blocks))
    assert result(turn_repair.report(table(spark, rows))) == brute(rows)


def _with_block(size, make):
    """Workers import the module afresh: carry the size along."""
    def blocks(kind):
        fn = make(kind)

        def run(batches):
            turn_repair.BLOCK = size
            yield from fn(batches)

        return run

    return blocks


def test_test_table(spark, rows):
    found = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in rows("conversations")]
    assert result(turn_repair.report(table(spark, found))) == brute(found)


def test_odd_tables(spark):
    odd = [(None, None, None, None), (None, 1, "user", "x" * 200_000 + "."), (5, None, "user", "Hi."), (5, None, "user", "Hi."), (5, None, "assistant", "Ho."), (6, -3, "assistant", "a.\x00"), (6, 9, "user", "b ")]
    odd += [(7, t, "user", "same.") for t in range(300)]
    clash = table(spark, odd).selectExpr("*", "1 as cost", "'x' as audit", "2 as said", "3 as block")
    assert result(turn_repair.report(clash)) == brute(odd)
    assert turn_repair.report(table(spark, odd).limit(0)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert result(turn_repair.report(table(spark, [(gone, 0, "user", "x.")]))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_auction_against_all_paths():
    rng = random.Random(3)
    for _ in range(3000):
        turns = [(rng.choice("suax"), "", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(0, 9))]
        turns = [(role, text, must, cut and not must) for role, text, must, cut in turns]
        codes = bytes("suax".index(role) + auction.MUST_GO * must + auction.CUT * cut for role, _, must, cut in turns)
        cost, letters, end = auction.Lattice(codes, auction.ENDS).path(0)
        assert (cost, letters + auction.TAILS[end]) == cheapest(turns)[:2]


def test_crossing_costs_add_up():
    rng = random.Random(4)
    for _ in range(500):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 5, 8, 9, 10]) for _ in range(rng.randrange(2, 12)))
        cut = rng.randrange(1, len(codes))
        a, b, both = auction.costs(codes[:cut]), auction.costs(codes[cut:]), auction.costs(codes)
        for p in range(4):
            for q in range(4):
                assert min(both[4 * p + q], auction.INFINITE) == min(min(a[4 * p + x] + b[4 * x + q] for x in range(4)), auction.INFINITE)
