"""Gazetteer entities against plain search, and the positional join against zip."""
import random

import pytest
from pyspark.sql import functions as F

from chronotext.operators import entities, sets


def plain(words, phrases):
    out, at = [], 0
    while words and at < len(words):
        found = max((n for n in range(1, 5) if " ".join(words[at : at + n]) in phrases and at + n <= len(words)), default=0)
        if found:
            phrase = " ".join(words[at : at + found])
            out.append((at, found, phrase, phrases[phrase]))
        at += found or 1
    return out


def test_entities_against_plain_search(spark):
    r = random.Random(1)
    rows = [(k % 50, None if k == 7 else [r.choice("abcd") for _ in range(r.randrange(12))], "x") for k in range(80)] + [(None, ["a", "b"], "x")]
    table = [("a b", "PERSON"), ("a b c", "PLACE"), ("b", "TERM"), ("c d a b", "PERSON"), ("d", "TERM"), ("d", "ORG"), ("", "TERM"), (None, "TERM"), ("zz", "TERM")]
    df = spark.createDataFrame(rows, "id long, ws array<string>, label string").repartition(4)
    gazetteer = spark.createDataFrame(table, "phrase string, label string")
    for labels in (None, ["PERSON", "TERM"]):
        phrases = {}
        for p, l in table:
            if p and (labels is None or l in labels):
                phrases[p] = min(l, phrases.get(p, l))
        got = sorted(repr((x.id, [tuple(e) for e in x.entities], x.persons, x.n_entities)) for x in entities.entities(df, "id", F.col("ws"), gazetteer, labels).collect())
        want = []
        for i, ws, _ in rows:
            e = plain(ws, phrases)
            want.append(repr((i, e, [p for _, _, p, l in e if l == "PERSON"], len(e))))
        assert got == sorted(want)
    assert [x.n_entities for x in entities.entities(df.limit(3), "id", F.col("ws"), gazetteer.limit(0)).collect()] == [0, 0, 0]


@pytest.mark.parametrize("parts", [1, 5])
def test_zip(spark, parts):
    a = spark.range(100, 140).toDF("v").repartition(3).sortWithinPartitions("v")
    b = spark.range(40).select((F.col("id") * 7 % 40).alias("v")).coalesce(parts)
    first, second = [r.v for r in a.collect()], [r.v for r in b.collect()]
    assert sorted(tuple(r) for r in sets.zipped(a, b).collect()) == sorted(zip(first, second))
    assert [r.place for r in sets.numbered(b).orderBy("place").collect()] == list(range(40)) and sets.zipped(a.limit(0), b.limit(0)).collect() == []
    with pytest.raises(ValueError):
        sets.zipped(a, b.limit(3))
