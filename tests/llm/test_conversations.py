"""Conversation repair against a plain search over all edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from bridgeflow.llm import conversations as cv, queries

SPACE = "[\x20\x09-\x0d]"


def damage(rows):
    """(conv, turn, role, text) after the damage, and all conversations."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(harm, text)
        out += [(conv, turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out, {r[0] for r in rows}


def cheapest(marked):
    """(cost, audit, lines) of the least audit by trying every edit; ``marked`` are (role, text, must go, price)."""
    after_role = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.lru_cache(None)
    def best(i, state, inserted):
        found = []
        if i == len(marked) and state in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                if (state, role[0]) in after_role:
                    c, a, r = best(i, after_role[state, role[0]], inserted + 1)
                    found.append((c + 3, "I" + a, (role + ":", *r)))
        if i < len(marked):
            role, text, gone, price = marked[i]
            c, a, r = best(i + 1, state, 0)
            found.append((c + 4, "D" + a, r))
            if not gone:
                if (state, role[:1]) in after_role:
                    c, a, r = best(i + 1, after_role[state, role[:1]], 0)
                    found.append((c + price, "K" + a, (f"{role}:{text}", *r)))
                for new in ("user", "assistant"):
                    if (state, new[0]) in after_role:
                        c, a, r = best(i + 1, after_role[state, new[0]], 0)
                        found.append((c + 3 + price, "R" + a, (f"{new}:{text}", *r)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def plain_version(rows, harmed=True):
    done, all_convs = damage(rows) if harmed else ([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], {r[0] for r in rows})
    out = {}
    for conv in all_convs:
        mine = sorted((r for r in done if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        counts, marked, seen, illegal = [0, 0, 0, 0], [], set(), 0
        for j, (_, _, role, text) in enumerate(mine):
            bare = re.sub(SPACE + r"*\Z", "", text)
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault in (1, 2), 3 if fault == 3 else 0))
            if j and mine[j - 1][2][:1] + role[:1] not in ("su", "ua", "au"):
                illegal += 1
        turns = {r[1] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, lines = cheapest(tuple(marked))
        out[conv] = (gaps, *counts[1:], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, rows, harmed=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = df.withColumns({c: F.lit("clash") for c in ("conv", "gone", "fault", "ends", "audit", "digest", "copy")})
    made = cv.repair(cv.damaged(clash) if harmed else cv.whole(clash))
    got = [tuple(r) for r in made.collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def random_rows(n, seed):
    rnd = random.Random(seed)
    texts = ["fine.", "cut", "fine too!  \n", "", "  \t", "again?", "é…", ".", "a\x85", None]
    roles = ["user", "assistant", "system", "tool", "", None, "ua"]
    out = []
    for conv in range(n):
        turn = rnd.randrange(3)
        for _ in range(rnd.choice([1, 2, 3, 5, 9])):
            role = rnd.choice(roles) if rnd.random() < 0.3 else rnd.choice(["user", "assistant"])
            out.append((None if conv == 7 else conv, None if rnd.random() < 0.05 else turn, role, rnd.choice(texts) if rnd.random() < 0.4 else f"text {rnd.randrange(6)}."))
            turn += rnd.choice([0, 1, 1, 1, 2])
    return out


@pytest.mark.parametrize("harmed", [True, False])
def test_random_conversations(spark, harmed):
    rows = random_rows(250, 11)
    want = plain_version(rows, harmed)
    assert repaired(spark, rows, harmed) == want
    assert {c for v in want.values() for c in v[6]} == set("KRDI")


def test_long_and_repeated(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(30_000)]
    rows += [(c, i, "user" if i % 2 == 0 else "assistant", "same.") for c in range(2, 40) for i in range(4)]
    rows += [(50, 0, "user", "x" * 500_000 + "."), (50, 0, "user", "x" * 500_000 + "."), (50, 1, "assistant", "y.")]
    got = repaired(spark, rows, harmed=False)
    lines = "\n".join(f"{r}:{x}" for _, _, r, x in rows[:30_000])
    assert got[1][-2:] == ("K" * 30_000, hashlib.sha256(lines.encode()).hexdigest())
    assert {got[c] for c in range(2, 40)} == {plain_version([r for r in rows if r[0] == 2], False)[2]}
    assert got[50] == plain_version([r for r in rows if r[0] == 50], False)[50]


def test_equal_ends_are_one_node():
    automaton = cv.Automaton()
    one = automaton.read(bytes([cv.symbol("a", 0), cv.symbol("u", 0)]))
    size = len(automaton.symbols)
    assert automaton.read(bytes([cv.symbol("a", 0), cv.symbol("u", 0)])) == one and len(automaton.symbols) == size
    automaton.read(bytes([cv.symbol("a", 0), cv.symbol("u", 0), cv.symbol("s", 3)]))
    assert len(automaton.symbols) == size + 1


def test_register_starts_anew(monkeypatch):
    automaton, other = cv.Automaton(), cv.Automaton()
    rnd = random.Random(2)
    signature = bytes(rnd.randrange(12) for _ in range(60))
    want = automaton.audit(automaton.read(signature))
    monkeypatch.setattr(cv, "REGISTERED", 10)
    assert other.audit(other.read(signature)) == want and not other.register


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cv.repair(cv.damaged(empty)).collect() == []


def test_all_rows_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(conv, 0, "user", "hello.")]) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query_has_the_contract_columns(spark, sf_dir):
    made = queries.op12_conversation_repair(spark, sf_dir)
    assert made.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {t for c, t in made.dtypes if c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} == {"bigint"}
