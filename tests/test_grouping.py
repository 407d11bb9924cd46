"""Greedy grouping against the sequential fold."""
import random

import pytest
from pyspark.sql import functions as F

from chronotext.operators import grouping, linkage


def fold(rows, same):
    """Each row's first member, row by row."""
    firsts, out = [], {}
    for r in rows:
        at = next((f for f in firsts if same(f, r)), None)
        if at is None:
            firsts.append(r)
            at = r
        out[r] = at
    return out


@pytest.mark.parametrize("finish", [0, 5, grouping.FINISH])
def test_pairs_equal_the_fold(spark, finish):
    random.seed(finish)
    nodes = random.sample(range(1000), 60)
    edges = {(random.choice(nodes), random.choice(nodes)) for _ in range(90)}
    edges |= {(a, b) for a, b in zip(sorted(nodes)[:9], sorted(nodes)[1:10])}  # a chain in order
    edges |= {(nodes[0], n) for n in nodes[20:45]}  # a hot row
    both = edges | {(b, a) for a, b in edges}
    expected = fold(sorted(nodes), lambda a, b: (a, b) in both)
    pairs = spark.createDataFrame([*edges, *list(edges)[:10], (None, nodes[1]), (nodes[0], 5000)], "a long, b long")
    got = grouping.greedy_groups(spark.createDataFrame([(n,) for n in [*nodes, None, nodes[3]]], "node long"), pairs, finish)
    assert {r.node: r.group_id for r in got.collect()} == expected and got.count() == len(nodes)


def test_no_pairs_and_no_nodes(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert grouping.greedy_groups(spark.createDataFrame([(3,), (1,)], "node long"), none).sort("node").collect() == [(1, 1), (3, 3)]
    assert grouping.greedy_groups(spark.createDataFrame([], "node long"), none).count() == 0


def test_one_block_holds_most_rows(spark):
    random.seed(4)
    rows = [(i, random.choice(["hot", "hot", "hot", "cold", None]), random.choice(["a", "b", "c", None, "star", "2024"]), "kept") for i in random.sample(range(10_000), 400)]
    free = lambda v: v in ("star", "2024")
    expected = fold(sorted(rows), lambda x, y: x[1] == y[1] and (x[2] == y[2] or free(x[2]) or free(y[2])))
    df = spark.createDataFrame(rows, "n long, k string, v string, group string")
    got = grouping.first_groups(df, ["k"], "n", F.col("v"), F.col("v").isin("star", "2024"))
    assert got.columns == ["n", "k", "v", "group", "group_id"]
    assert {r.n: r.group_id for r in got.collect()} == {r[0]: f[0] for r, f in expected.items()}
    assert grouping.first_groups(df.limit(0), ["k"], "n", F.col("v"), F.lit(None).cast("boolean")).count() == 0


def test_a_free_row_takes_all_only_if_it_is_first(spark):
    def groups(values):
        df = spark.createDataFrame(list(enumerate(values)), "n long, v string").withColumn("k", F.lit(1))
        return [r.group_id for r in grouping.first_groups(df, ["k"], "n", F.col("v"), F.col("v") == "*").sort("n").collect()]
    assert groups(["*", "a", "b"]) == [0, 0, 0]
    assert groups(["a", "b", "*", "b"]) == [0, 1, 0, 1]


def test_titles(spark):
    titles = ["runaway", "Runawy", "runaway", "gone", None, "late night tale", "night tale late live", "...", "gon", "runawayy"]
    df = spark.createDataFrame(list(enumerate(titles)), "k long, t string")
    norm = lambda t: "".join(c for c in (t or "").lower() if c.isalnum() or c == " ").strip()
    expected = fold(range(len(titles)), lambda a, b: bool(norm(titles[a])) and bool(norm(titles[b])) and linkage.token_set(norm(titles[a]), norm(titles[b])) >= 85)
    for finish in (0, grouping.FINISH):
        assert {r.k: r.group_id for r in grouping.title_groups(df, "k", "t", 85.0, finish).collect()} == expected
