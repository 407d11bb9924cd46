"""Conversation repair: distances against Bellman-Ford, audits against all edit sequences, counts and edge cases."""
import hashlib
import itertools
import random
import re
import zlib

import pytest

from chronotext.llm import repair

ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", "u"]
BODIES = ["Yes.", "No", "Yes.", "  ", "", "why?\n", "é", "end!"]


def brute(rows, most_inserts=3):
    """(cost, audit, lines) over all edit sequences of (role, text) rows with at most so many inserts at a place."""
    faults, seen = [], set()
    for role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if blank else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    choices = [["D"] if f in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for f in faults]
    puts = ["".join(p) for n in range(most_inserts + 1) for p in itertools.product("ua", repeat=n)]
    names = {"u": "user", "a": "assistant"}

    def go(at, cost, audit, lines, shape):
        nonlocal best
        if not re.fullmatch("(s?(ua)*u?)?", shape) or best and cost > best[0]:
            return
        if at == len(rows) + 1:
            if re.fullmatch("(s?(ua)+)?", shape):
                best = min(best or (cost, audit, lines), (cost, audit, lines))
            return
        for put in puts:
            c, a, sh, li = cost + 3 * len(put), audit + "I" * len(put), shape + put, lines + [f"{names[x]}:" for x in put]
            if at == len(rows):
                go(at + 1, c, a, li, sh)
                continue
            role, text = rows[at]
            for e in choices[at]:
                extra = 3 if faults[at] == "truncated" and e != "D" else 0
                if e == "D":
                    go(at + 1, c + 4, a + "D", li, sh)
                elif e == "K":
                    go(at + 1, c + extra, a + "K", [*li, f"{role}:{text}"], sh + (role[:1] or "?"))
                else:
                    go(at + 1, c + 3 + extra, a + "R", [*li, f"{names[e[1]]}:{text}"], sh + e[1])

    go(0, 0, "", [], "")
    return best


def counts(rows, turns):
    """gaps, blank, duplicate, truncated, illegal."""
    seen, blank, duplicate, truncated = set(), 0, 0, 0
    for role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]", "", text)
        if not kept:
            blank += 1
        elif (role, text) in seen:
            duplicate += 1
        elif kept[-1] not in ".!?":
            truncated += 1
        seen.add((role, text))
    numbers = [t for t in turns if t is not None]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, blank, duplicate, truncated, illegal


def test_edits_against_all_sequences():
    r = random.Random(5)
    for _ in range(150):
        rows = [(r.choice(ROLES), r.choice(BODIES)) for _ in range(r.randrange(5))]
        blank, duplicate, truncated, illegal, cost, audit, turns = repair.repair([(a, b, 1) for a, b in rows])
        assert (cost, audit, [f"{a}:{b}" for a, b in turns]) == brute(rows)
        assert (blank, duplicate, truncated, illegal) == counts(rows, [0])[1:]


def test_distances_against_bellman_ford():
    r = random.Random(6)
    for n in (0, 1, 7, 40, 200):
        rows = tuple(r.choice([None, ("u", True), ("u", False), ("a", False), ("a", True), ("s", False), ("", False)]) for _ in range(n))
        best = [[repair.FAR] * 4 for _ in range(n + 1)]
        best[n][repair.START] = best[n][repair.ASSISTANT] = 0
        for at in range(n, -1, -1):
            for s in range(4):
                if at < n:
                    best[at][s] = min(c + best[at + 1][to] for _, c, to in repair.over(rows[at], s))
            for _ in range(4):
                for s in range(4):
                    best[at][s] = min(best[at][s], 3 + best[at][repair.NEXT[s][1]])
        assert repair.distances(rows) == [c for row in best for c in row]
        edits = repair.walk(rows, repair.distances(rows))
        assert [at for _, at, _ in edits if at is not None] == list(range(n))


def test_repeats_are_counted():
    once = repair.repair([("user", "Hi.", 1)] + [("user", "Hi.", 1)] * 999 + [("assistant", "", 1)] * 5)
    assert once == repair.repair([("user", "Hi.", 1000), ("assistant", "", 5)])
    assert once[5] == "K" + "D" * 1004 + "I" and once[4] == 4 * 1004 + 3


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id long, turn long, role string, text string, times int, audit string")


def test_conversations(spark):
    r = random.Random(7)
    rows = [(c, r.choice([None, 0, 1, 2, 3, 7]), r.choice([*ROLES, None]), r.choice([*BODIES, None, "long " * 3000 + "."])) for c in [None, *range(40)] for _ in range(r.randrange(1, 5))]
    want = {}
    for c in {x[0] for x in rows}:
        mine = sorted(((x[1] is not None, x[1] or 0, " " if x[2] is None else x[2], " " if x[3] is None else x[3]) for x in rows if x[0] == c))
        pairs = [x[2:] for x in mine]
        want[c] = (*counts(pairs, [x[1] for x in mine if x[0]]), *brute(pairs))
    made = repair.repair_conversations(table(spark, rows).repartition(5)).collect()
    assert {m.conv_id: (m.gaps, m.blank, m.duplicate, m.truncated, m.illegal, m.cost, m.audit, [f"{t.role}:{t.text}" for t in m.repaired]) for m in made} == want


def test_damage_and_absent_rows(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Text {t}. Why?") for c in range(30) for t in range(6)] + [(None, None, None, None), (99, -(2**63), "user", "a."), (99, 2**63 - 1, "user", "b.")]
    made = {}
    for c, t, role, text in rows:
        deal = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        made[(c, t)] = ("user" if deal == 4 else role or " ", "" if deal == 1 else re.sub("[.!?]", "", text or " ") if deal == 2 else text or " ", {0: 0, 3: 2}.get(deal, 1))
    got = repair.damaged(table(spark, rows))
    assert {(r.conv_id, r.turn): (r.role, r.text, r.times) for r in got.collect()} == made
    assert {m[2] for m in made.values()} == {0, 1, 2}
    out = {r.conv_id: r for r in repair.repair_conversations(got.union(spark.createDataFrame([(500, 1, "user", "a", 0)], got.schema)), times="times").collect()}
    assert set(out) == {c for c, *_ in rows} | {500}
    assert (out[500].cost, out[500].audit, out[500].repaired, out[500].gaps) == (0, "", [], 0)
    assert repair.repair_conversations(table(spark, rows).limit(0)).collect() == []


def test_query_reads_back(spark):
    made = {r.conv_id: r for r in repair.op11_repair(spark, "/root/testdata/sf0.001").collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.audit == "") <= (r.repaired_sha256 == empty) for r in made.values())
    assert set(made) == {r.conv_id for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id").distinct().collect()}


@pytest.mark.parametrize("n", [30, 5000])
def test_long_conversations(n):
    turns = [(("user", "assistant")[k % 2], f"line {k}.", 1) for k in range(n)]
    assert repair.repair(turns)[4:] == (0, "K" * n, [t[:2] for t in turns])
    assert repair.repair(turns[1:])[4:6] == (3, "I" + "K" * (n - 1))
