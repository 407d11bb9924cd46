"""Logistic regression: gradient against finite differences, one process, held-out labels, scoring of rows."""
import numpy as np
from pyspark.sql import functions as F

from chronotext.operators import linear, models

CLASSES = ["negative", "neutral", "positive"]
ROWS = [("good fine great day", "positive"), ("bad awful day", "negative"), ("a day", "neutral"), (None, "neutral"), ("", "positive"), ("great great Great", "positive"), ("awful", "other"), ("bad", None), ("bad bad thing", "negative")] * 3


def test_gradient_against_differences(spark):
    df = spark.createDataFrame(ROWS, "t string, label string").repartition(3)
    rows = linear.prepared(df, "t", "label", CLASSES, 6)
    random = np.random.default_rng(1)
    weights = random.standard_normal((3, 65))
    value, slope = linear.loss_and_gradient(rows, weights, 21, 0.1, 6)
    model = linear.Linear(CLASSES, weights, 6)
    want = sum(-np.log(model.scores(t)[CLASSES.index(c)]) for t, c in ROWS if c in CLASSES) / 21 + 0.05 * (weights[:, :-1] ** 2).sum()
    assert abs(value - want) < 1e-9
    for c, k in [(0, 64), (1, 64), *((int(random.integers(3)), int(random.integers(64))) for _ in range(4))]:
        moved = weights.copy()
        moved[c, k] += 1e-5
        more = linear.loss_and_gradient(rows, moved, 21, 0.1, 6)[0]
        moved[c, k] -= 2e-5
        assert abs((more - linear.loss_and_gradient(rows, moved, 21, 0.1, 6)[0]) / 2e-5 - slope[c, k]) < 1e-6


def test_fit_and_score(spark):
    df = spark.createDataFrame(ROWS, "t string, label string")
    model = linear.fit(df, "t", "label", CLASSES, decay=1e-3, bits=8)
    assert all(b <= a for a, b in zip(model.losses, model.losses[1:])) and len(model.losses) > 3
    load, schema = linear.scorer(model)
    texts = spark.createDataFrame([(1, "a great day"), (2, "awful"), (3, None)], "k long, t string")
    got = {r.k: r for r in models.score_rows(texts, "t", load, schema).collect()}
    assert got[1].label == "positive" and got[2].label == "negative" and got[3].label is None and abs(sum(got[1].scores) - 1) < 1e-3
    none = linear.fit(df.limit(0), "t", "label", CLASSES, bits=8)
    assert np.allclose(none.scores("any"), 1 / 3)


def test_held_out_labels(spark):
    data = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{data}/documents.parquet").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    rows = rows.select("text", F.col("quality").cast("string").alias("label"), (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held"))
    model = linear.fit(rows.where(~F.col("held")), "text", "label", ["0", "1"], rounds=12)
    held = [(r.text, r.label) for r in rows.where("held and label is not null").collect()]
    right = sum(model.classes[int(model.scores(t).argmax())] == c for t, c in held) / len(held)
    most = max(sum(c == k for _, c in held) for k in "01") / len(held)
    print(right, most, len(held))
    assert right >= most
