"""The fuzzy title join against all pairs."""
import random

import pytest

from chronotext.operators import fuzzy, linkage


def titles(seed, n):
    r = random.Random(seed)
    vocabulary = ["the", "a", "of", "run", "runaway", "away", "moon", "red", "night", "late", "song", "gone", "blood", "leaves", "power", "x", "on"] + ["".join(r.choices("abcde", k=r.randrange(1, 9))) for _ in range(40)]
    out = []
    for _ in range(n):
        t = list(" ".join(r.choices(vocabulary, weights=[30] * 3 + [3] * (len(vocabulary) - 3), k=r.randrange(1, 6))))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            k = r.randrange(len(t) + 1)
            t[k : k + r.randrange(2)] = r.choice(["", "e", "q", " "])
        out.append(" ".join("".join(t).split()))
    return out


LEFT = titles(1, 260) + ["runawy", "gone", "the", "late night", "", None, "z", "on x", "red red moon", "b" * 3000, " ".join(f"w{k}" for k in range(700))]
RIGHT = titles(2, 260) + ["runaway", "gon", "the the", "late nihgt", "", None, "zz", "x on", "moon red", "b" * 2990 + "ccc", " ".join(f"w{k}" for k in range(3, 700))]


@pytest.mark.parametrize("least,block", [(88, 4096), (82, 7), (100, 4096), (60, 50)])
def test_all_pairs(spark, least, block):
    a, b = spark.createDataFrame([(t, 1) for t in LEFT], "t string, b int").repartition(3), spark.createDataFrame([(t, 1) for t in RIGHT], "u string, a int").repartition(2)
    got = sorted((r.a, r.b, round(r.score, 9)) for r in fuzzy.similar_titles(a, b, "t", "u", least, block).collect())
    every = ((x, y, linkage.token_set(x, y)) for x in set(LEFT) if x for y in set(RIGHT) if y)
    want = sorted((x, y, round(s, 9)) for x, y, s in every if s >= least)
    assert got == want and len(want) > 30
    if least <= 82:
        assert {("runawy", "runaway"), ("gone", "gon")} <= {w[:2] for w in want}


def test_pieces_suffice_for_every_length():
    for least in (80, 82, 88, 99):
        for m in range(1, 80):
            words = ["a"] * ((m - 1) // 2) + ["bb" if m % 2 == 0 else "a"]
            assert all(gram for gram, _ in fuzzy._asked(least)(" ".join(words)))


def test_best_of_typed_titles(spark):
    left = spark.createDataFrame([(1, "Runawy"), (2, "RUNAWAY!"), (3, "nothing like it"), (4, None)], "k long, t string")
    right = spark.createDataFrame([("runaway", 5), ("Runaway", 9), ("run", 7), ("runawayy", 1), (None, 8)], "u string, w int")
    got = sorted((r.k, r.match.u, r.match.w, round(r.score, 1)) for r in linkage.best_match(left, right, "t", "u", "w").collect())
    assert got == [(1, "Runaway", 9, 92.3), (2, "Runaway", 9, 100.0)]
    from pyspark.sql import functions as F
    far = linkage.best_match(left, right, "t", "u", "w", extra=F.when(F.col("r.w") == 1, 20.0).otherwise(0.0))
    assert sorted((r.k, r.match.u) for r in far.collect()) == [(1, "runaway"), (2, "runawayy")] or sorted((r.k, r.match.u) for r in far.collect())[1] == (2, "runawayy")
    assert fuzzy.similar_titles(left.limit(0), right, "t", "u", 88).collect() == []
