"""Cases of the findings of the fourth round."""
import pathlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronotext.functions import text
from chronotext.operators import density, entities, fuzzy, lineage, linkage
from tests.test_findings_r03 import shuffled


def spoken(n, seed=4):
    r = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "st", "ou", "ea", "ly"]
    return ["".join(c for c in " ".join("".join(r.choices(parts, k=r.randrange(1, 4))) for _ in range(r.randrange(5, 9)))) for _ in range(n)]


def test_f1_f2_titles_of_common_pieces_are_compared_in_groups(spark):
    """A title isn't shuffled once for each of its pieces, whose lists hold nearly all titles."""
    titles = spoken(1500)
    titles += [t[:9] + "x" + t[10:] for t in titles[:300]] + ["m" * 150 + " th", "m" * 149 + " th"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").cache()
    told = []
    n = shuffled(spark, lambda: told.extend(fuzzy.similar_titles(rows, rows, "t", "t", 88.0, once=True).collect()))
    found = {tuple(sorted((r.a, r.b))) for r in told}
    some = random.Random(6).sample(titles, 60) + titles[-2:]
    assert all((tuple(sorted((a, b))) in found) == (linkage.token_set(a, b) >= 88) for a in some for b in set(titles))
    assert n < 100 * len(titles)


@pytest.mark.parametrize("once", [True, False])
def test_f1_f2_groups_of_one_length_are_sliced(spark, monkeypatch, once):
    sizes = {3: 10, 4: 5000, 5: 20, 9: 900, 10: 400}
    assert fuzzy._groups(sizes, 1024) == {3: (0, 1), 4: (1, 5), 5: (6, 1), 9: (6, 1), 10: (7, 1)}
    titles = spoken(300)
    titles += [t[:9] + "x" + t[10:] for t in titles[:100]]
    df = spark.createDataFrame([(t,) for t in titles], "title string").select(F.xxhash64("title").alias("id"), "title").distinct()
    whole = {tuple(r) for r in fuzzy._compared(df, df, 80.0, once, fuzzy.GROUP).collect()}
    monkeypatch.setattr(fuzzy, "TOGETHER", 20)
    small = [tuple(r) for r in fuzzy._compared(df, df, 80.0, once, 20).collect()]
    pairs = (lambda told: {frozenset(p) for p in told}) if once else set
    assert pairs(whole) == pairs(small) and len(pairs(small)) == len(small) and len(pairs(whole)) > 450


def test_f1_f2_common_lengths():
    r = random.Random(3)
    left, right = (["".join(r.choices("abcé ", k=r.randrange(70))) for _ in range(500)] for _ in range(2))
    assert fuzzy._common_lengths(left, right).tolist() == [linkage.lcs(a, b) if len(a) <= 64 else -1 for a, b in zip(left, right)]


def test_f1_first_tokens_are_the_first_of_all_tokens(spark):
    rows = spark.createDataFrame([(t,) for t in ("One, two—three", "", None, "...", "a b c d e f", "x" * 9000 + " y", " it's\n'tis 42 ok", "ÉCOLE Été")], "t string")
    for n in (1, 2, 8):
        assert all(r.a == r.b for r in rows.select(text.first_tokens(F.col("t"), n).alias("a"), F.slice(text.tokens(F.col("t")), 1, n).alias("b")).collect())


def test_f6_words_of_a_batch_are_gone_through_in_slices():
    """A task holds a few arrays over a slice's words, not over all words of an Arrow batch or a block."""
    sizes = np.array([0, 700] * 2000 + [400_000])
    words = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, sizes.sum())
    hs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(words))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(sizes)) % 5), hs], names=["block", "hs"])
    parts = list(entities._slices(batch, "hs"))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and all(len(p.column(1).flatten()) <= entities.WORDS or len(p) == 1 for p in parts)
    held = type("Held", (), {"value": np.full(entities.PLACES, 1 << 7, np.uint64)})
    tracemalloc.start()
    for _ in entities._asked(held, {1, 2, 3})([batch]):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6


def test_f6_entities_of_slices_are_those_of_the_block(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [f"w{(k * j) % 11}" for j in range(k % 23)]) for k in range(120)] + [(200, None)], "id long, ws array<string>")
    gazetteer = spark.createDataFrame([("w1", "TERM"), ("w2 w4", "PERSON"), ("w3 w6 w9", "PLACE")], "phrase string, label string")
    whole, parts = [], []
    for size, told in ((entities.WORDS, whole), (30, parts)):
        monkeypatch.setattr(entities, "WORDS", size)
        told.extend(sorted(map(str, entities.entities(rows, "id", F.col("ws"), gazetteer).collect())))
    assert whole == parts and len(whole) == 121


def test_f5_vectors_are_sent_once_a_cell_and_rows_are_compared_in_parts(spark, monkeypatch):
    """A cell of up to 4,096 nodes is one block, so its vectors aren't repeated; parts of a block give what the whole gives."""
    x = np.random.default_rng(8).standard_normal((1500, density.WIDTH))
    x = np.round(x / np.sqrt((x * x).sum(1, keepdims=True)), 6)
    nodes = spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(x)], "node long, weight long, v array<double>").cache()
    nodes.count()
    told = []
    n = shuffled(spark, lambda: told.extend(density.neighbours(nodes, 5).collect()))
    d = np.round(np.maximum(1 - x @ x.T, 0), 9)
    np.fill_diagonal(d, np.inf)
    assert {(r.a, r.b) for r in told} == {(k, int(j)) for k in range(len(x)) for j in np.lexsort((np.arange(len(x)), d[k]))[:5]}
    assert n < 1.5 * len(x) + 6 * len(x)
    assert set(density.neighbours(nodes, 5, block=300).collect()) == set(told)
    words = spark.range(300).select(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.concat(F.lit("word"), i % 50)).alias("ws"))
    kept = lineage.packed(words)
    size = sum(f.stat().st_size for f in pathlib.Path(kept.inputFiles()[0].removeprefix("file:").replace("//", "/")).parent.iterdir())
    assert kept.count() == 300 and size < 300 * 400 * 8
