"""Conversation structure repair: the cheapest edits that give a conversation's roles the order ``(s?(ua)+)?``.

A node is (rows read, what the order expects next); an arc is an edit.  Keep costs 0, rerole to user or assistant 3,
delete 4, an empty turn of user or assistant put in 3; a truncated row that stays costs 3 more; blank and duplicate
rows must go.  Costs are small integers, so distances come from Dial's bucket queue: it settles nodes backwards from
the end, one bucket for each cost modulo the largest arc + 1.  Then a walk from the start takes the least letter (D, I,
K, R) among the tight arcs, which gives the ASCII-least audit of those of least cost.  An audit fixes the result: what
may come next leaves one role for a rerole or an insert.

A row's first fault counts: *blank* (only space characters), *duplicate* (role and text seen earlier in the
conversation), *truncated* (its last other character isn't one of ``.!?``).

Rows of a conversation are taken by turn (nulls first), then role and text.  Rows equal in all of these are counted
before the shuffle, so that a row repeated without end is one row with a number; of blank rows all must go, of others
all but the first.  Null roles and texts are one space, so a null text is blank.  Conversations with a null id are one
conversation, whose id stays null.  A conversation none of whose rows is there (``times`` 0) gives zeros, an empty audit
and no turns.  Gaps wrap around beyond 64 bits.  An empty table gives an empty result; other columns are not read.  A
task holds one conversation's distinct rows at a time, however long their texts.
"""
import functools
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import lean

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BUCKETS = max(DELETE, INSERT, REROLE + TRUNCATED) + 1
WORD = re.compile(r"[^\x20\x09-\x0D]")
SPACES = "\x20\t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)  # who spoke last
ALLOWED = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60


def over(row, state):
    """(letter, cost, next state) of the edits of a row: (initial, truncated), or ``None`` for one that must go, whose
    deletion is paid for apart."""
    if row is None:
        return [("D", 0, state)]
    initial, truncated = row
    extra = TRUNCATED if truncated else 0
    out = [("D", DELETE, state), ("R", REROLE + extra, NEXT[state][1])]
    if initial in ALLOWED[state]:
        out.append(("K", extra, ALLOWED[state][initial]))
    return out


def distances(rows):
    """Cost from each node (rows read * 4 + state) to the end of ``rows``, by Dial's queue over the arcs reversed."""
    best = [FAR] * (4 * len(rows) + 4)
    queue = [[] for _ in range(BUCKETS)]
    into = {row: [[(s, c) for s in range(4) for _, c, to in over(row, s) if to == state] for state in range(4)] for row in set(rows)}
    inserted = [[s for s in range(4) if NEXT[s][1] == state] for state in range(4)]
    cost = waiting = 0

    def reach(node, c):
        nonlocal waiting
        if c < best[node]:
            best[node] = c
            queue[c % BUCKETS].append(node)
            waiting += 1

    for state in (START, ASSISTANT):
        reach(4 * len(rows) + state, 0)
    while waiting:
        bucket = queue[cost % BUCKETS]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if best[node] == cost:
                at, state = divmod(node, 4)
                for s in inserted[state]:
                    reach(4 * at + s, cost + INSERT)
                if at:
                    for s, c in into[rows[at - 1]][state]:
                        reach(4 * at - 4 + s, cost + c)
        cost += 1
    return best


def walk(rows, best):
    """The ASCII-least cheapest edits: (letter, row or ``None``, state after it)."""
    at, state, out = 0, START, []
    while True:
        here = best[4 * at + state]
        tight = [("I", None, NEXT[state][1])] if here == INSERT + best[4 * at + NEXT[state][1]] else []
        if at < len(rows):
            tight += [(letter, at, to) for letter, cost, to in over(rows[at], state) if here == cost + best[4 * at + 4 + to]]
        elif here == 0:
            return out
        edit = min(tight, key=lambda e: e[0])
        out.append(edit)
        at, state = at + (edit[1] is not None), edit[2]


@functools.lru_cache(maxsize=2048)
def _cheapest_of_short(rows):
    best = distances(rows)
    return best[START], tuple(walk(rows, best))


def cheapest(rows):
    """(cost, edits) of a tuple of rows; short ones, which often look alike, are remembered."""
    if len(rows) <= 24:
        return _cheapest_of_short(rows)
    best = distances(rows)
    return best[START], walk(rows, best)


def repair(turns):
    """(blank, duplicate, truncated, illegal, cost, audit, repaired turns) of the (role, text, times) rows in order."""
    seen, rows, of, times_of = set(), [], [], []
    blank = duplicate = truncated = illegal = 0
    last = None

    def gone(k, times):
        rows.append(None)
        of.append(k)
        times_of.append(times)

    for k, (role, text, times) in enumerate(turns):
        initial = role[:1]
        illegal += (last is not None and last + initial not in LEGAL) + times - 1
        last = initial
        if not WORD.search(text):
            blank += times
            gone(k, times)
        elif (role, text) in seen:
            duplicate += times
            gone(k, times)
        else:
            seen.add((role, text))
            cut = text.rstrip(SPACES)[-1] not in ".!?"
            truncated += cut
            rows.append((initial if initial in ("s", "u", "a") else "", cut))
            of.append(k)
            times_of.append(1)
            if times > 1:
                duplicate += times - 1
                gone(k, times - 1)
    cost, edits = cheapest(tuple(rows))
    audit, out = [], []
    for letter, at, state in edits:
        audit.append(letter * (1 if at is None else times_of[at]))
        if letter == "I":
            out.append(("assistant" if state == ASSISTANT else "user", ""))
        elif letter == "K":
            out.append(turns[of[at]][:2])
        elif letter == "R":
            out.append(("assistant" if state == ASSISTANT else "user", turns[of[at]][1]))
    return blank, duplicate, truncated, illegal, cost + DELETE * (blank + duplicate), "".join(audit), out


MADE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def _repairs(batches):
    done, current, turns, numbers, kind, held = [], None, [], [], None, 0

    def close():
        distinct = len(set(numbers))
        gaps = max(numbers) - min(numbers) + 1 - distinct if numbers else 0
        *counts, repaired = repair(turns)
        done.append((current, (gaps + (1 << 63)) % (1 << 64) - (1 << 63), *counts, [{"role": r, "text": t} for r, t in repaired]))

    def flush():
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
        columns = list(zip(*done)) or [()] * len(types)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"])

    first = True
    for batch in batches:
        kind = batch.schema.types[0]
        for conv, turn, role, text, times in zip(*(c.to_pylist() for c in batch.columns)):
            if first or conv != current:
                if not first:
                    close()
                current, turns, numbers, first = conv, [], [], False
            if times:
                turns.append((role, text, times))
                held += len(text)
                if turn is not None and (not numbers or numbers[-1] != turn):
                    numbers.append(turn)
            if len(done) >= 1000 or done and held > 4_000_000:
                yield flush()
                held = 0
    if not first:
        close()
        yield flush()


def repair_conversations(rows, conv_id="conv_id", turn="turn", role="role", text="text", times=None):
    """One row per conversation: its id (as ``conv_id``), gaps, blank, duplicate, truncated, illegal, cost, audit and
    the repaired turns, array<struct<role,text>>.

    ``times``: a column that says how often a row is there; 0 keeps only its conversation in the result."""
    n = F.lit(1) if times is None else F.coalesce(F.col(times), F.lit(0))
    there = n > 0
    columns = [F.when(there, c) for c in (F.col(turn).cast("long"), F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" ")))]
    source = rows.select(F.col(conv_id).alias("conv_id"), *(c.alias(x) for c, x in zip(columns, ("turn", "role", "text"))), n.cast("long").alias("n"))
    keys = ["conv_id", "turn", "role", "text"]
    counted = source.groupBy(*keys).agg(F.sum("n").alias("times"))
    dealt = counted.repartition("conv_id").sortWithinPartitions(*keys)
    schema = T.StructType([T.StructField("conv_id", rows.schema[conv_id].dataType), *T._parse_datatype_string(MADE).fields])
    return dealt.mapInArrow(lean(_repairs), schema)


def damaged(turns):
    """Rows conv_id, turn, role, text, times: by the crc32 of ``conv_id:turn`` modulo 20, 0 drops a row, 1 empties its
    text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's.  Nulls count as one space."""
    one = F.lit(" ")
    deal = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), one) for c in ("conv_id", "turn")))) % 20
    text = F.coalesce("text", one)
    return turns.select("conv_id", "turn", F.when(deal == 4, "user").otherwise(F.coalesce("role", one)).alias("role"),
                        F.when(deal == 1, "").when(deal == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(deal == 0, 0).when(deal == 3, 2).otherwise(1).alias("times"))


def op11_repair(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    made = repair_conversations(damaged(turns), times="times")
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return made.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))


# Not Dial's queue: each row extends the least (cost, audit, text) that ends in each state, inserts closed after it.
_CRC = "list_reduce([4294967295::UBIGINT] || list_transform(string_split({0}, ''), lambda c: ascii(c)::UBIGINT), lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))"


def _sql():
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    names = ("s0", "s1", "s2", "s3")
    kind = "STRUCT(" + ", ".join(f"{n} STRUCT(c BIGINT, a VARCHAR, t VARCHAR)" for n in names) + ", role VARCHAR, body VARCHAR, go BOOLEAN, cut BIGINT)"
    far = "{'c': 1000000000, 'a': '', 't': ''}"

    def step(source, cost, letter, text):
        return f"{{'c': {source}.c + {cost}, 'a': {source}.a || '{letter}', 't': {source}.t || {text}}}"

    def only(condition, value):
        return f"CASE WHEN {condition} THEN {value} ELSE {far} END"

    def after(state):
        ways = [step("p." + state, 4, "D", "''")]
        keep, line = "chr(10) || x.role || ':' || x.body", "chr(10) || '{}:' || x.body"
        if state == "s1":
            ways.append(only("NOT x.go AND x.role[1] = 's'", step("p.s0", "x.cut", "K", keep)))
        if state == "s2":
            for source in ("s0", "s1", "s3"):
                ways.append(only("NOT x.go AND x.role[1] = 'u'", step("p." + source, "x.cut", "K", keep)))
                ways.append(only("NOT x.go", step("p." + source, "3 + x.cut", "R", line.format("user"))))
        if state == "s3":
            ways.append(only("NOT x.go AND x.role[1] = 'a'", step("p.s2", "x.cut", "K", keep)))
            ways.append(only("NOT x.go", step("p.s2", "3 + x.cut", "R", line.format("assistant"))))
        return f"least({', '.join(ways)})"

    def closed(p, rounds=3):
        sql = p
        for _ in range(rounds):
            user = ", ".join(step(f"q.{s}", 3, "I", "chr(10) || 'user:'") for s in ("s0", "s1", "s3"))
            assistant = step("q.s2", 3, "I", "chr(10) || 'assistant:'")
            sql = f"list_transform([{sql}], lambda q: {{'s0': q.s0, 's1': q.s1, 's2': least(q.s2, {user}), 's3': least(q.s3, {assistant}), 'role': q.role, 'body': q.body, 'go': q.go, 'cut': q.cut}})[1]"
        return sql

    first = closed("{'s0': {'c': 0::BIGINT, 'a': '', 't': ''}, 's1': " + far + ", 's2': " + far + ", 's3': " + far + ", 'role': '', 'body': '', 'go': false, 'cut': 0::BIGINT}::" + kind)
    moved = closed("{" + ", ".join(f"'{n}': {after(n)}" for n in names) + ", 'role': '', 'body': '', 'go': false, 'cut': 0::BIGINT}::" + kind)
    return rf"""
WITH h AS (
  SELECT conv_id, turn, xor({_CRC.format(key)}, 4294967295) % 20 AS deal, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN deal = 4 THEN 'user' ELSE role END AS role,
    CASE deal WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE deal WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h
), n AS (
  SELECT *, row_number() OVER w AS place, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS time,
    lag(role) OVER w AS before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN time > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM n
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'s0': {far}, 's1': {far}, 's2': {far}, 's3': {far}, 'role': role, 'body': text, 'go': fault IN ('blank', 'duplicate'), 'cut': CASE fault WHEN 'truncated' THEN 3 ELSE 0 END}}::{kind} ORDER BY place) AS rows
  FROM f GROUP BY conv_id
), r AS (
  SELECT *, list_reduce(list_prepend({first}, rows), lambda p, x: {moved}) AS e FROM g
), b AS (
  SELECT *, least(e.s0, e.s3) AS best FROM r
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL = _sql()
