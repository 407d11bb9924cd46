"""N-gram join and suffix-array dedup against brute force."""
import random

import numpy as np
import pytest

from chronotext.llm import jaccard, suffix_dedup

from . import cases


def near_copies(seed=1):
    r = random.Random(seed)
    base = [f"t{r.randrange(5000)}" for _ in range(120)]
    out = [" ".join(base)]
    for k in range(60):
        words = list(base)
        for _ in range(k % 7):
            words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out + [" ".join(f"t{r.randrange(5000)}" for _ in range(r.randrange(1, 60))) for _ in range(60)]


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_join(spark, monkeypatch, width, percent):
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    monkeypatch.setattr(jaccard, "FREQUENT_LOCAL", 2)
    texts = cases.TEXTS + near_copies()
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.classes(cases.frame(spark, texts).repartition(5), width=width, percent=percent).collect()}
    assert got == dict(enumerate(cases.classes(texts, width, percent)))


def test_join_large_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LARGE", 100)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    monkeypatch.setattr(jaccard, "FREQUENT_LOCAL", 1)
    texts = near_copies(2)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.classes(cases.frame(spark, texts)).collect()}
    assert got == dict(enumerate(cases.classes(texts, 3, 90)))


def test_join_empty_and_repeated(spark):
    df = cases.frame(spark, ["a b c d", "a b c d"])
    assert jaccard.classes(df.limit(0)).count() == 0
    assert jaccard.classes(df.unionAll(df)).count() == 4
    assert sorted(r.doc_id for r in jaccard.one_of_each(cases.frame(spark, cases.TEXTS)).collect()) == [0, 1, 2, 3, 4, 5, 8, 12, 13, 14, 15, 16]
    kept = jaccard.one_of_each(df.unionAll(df))
    assert kept.columns == df.columns and kept.count() == 1


def test_suffix_array():
    r = random.Random(3)
    for n in [1, 2, 3, 4, 5, 7, 8, 12, 50, 333]:
        for k in (1, 2, 3, 50):
            s = np.array([r.randint(1, k) for _ in range(n)], dtype=np.int64)
            assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_suffix_array_very_long_texts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    data = np.frombuffer(cases.TEXTS[15].encode(), np.uint8)
    parts = list(suffix_dedup.pieces(data, np.array([0, len(data)]), 200))
    covered = {at + k for part, _, at in parts for k in range(len(part) - 199)}
    assert covered == set(range(len(data) - 199))


@pytest.mark.parametrize("frequent", [400, 2])
def test_removed(spark, monkeypatch, frequent):
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    r = random.Random(4)
    shared = "".join(r.choice("abcdef ") for _ in range(1500))
    texts = cases.TEXTS + [shared[a : a + n] + f" end {k}" * 3 for k, (a, n) in enumerate((r.randrange(900), r.randrange(150, 600)) for _ in range(25))]
    got = {x.id: (x.n_removed, [(s.start, s.end) for s in x.spans], x.kept_sha256) for x in suffix_dedup.removed(cases.frame(spark, texts).repartition(5)).collect()}
    assert got == dict(enumerate(cases.repeats(texts, 200)))


def test_dedup(spark):
    df = cases.frame(spark, cases.TEXTS)
    out = suffix_dedup.dedup(df)
    assert out.columns == df.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[5] == cases.TEXTS[5] and texts[0] is None and texts[10] == " tail" and 8 not in texts
    assert suffix_dedup.dedup(df.limit(0)).count() == 0 and suffix_dedup.removed(df.limit(0)).count() == 0
