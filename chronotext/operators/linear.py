"""Trained text scorers: multinomial logistic regression over hashed words, by L-BFGS with gradients summed in Spark.

A text is its words' counts, thrown into ``2 ** bits`` places by hash with a sign, dampened (1 + log) and brought to
length 1.  Every labelled row counts in every gradient: a task adds up its rows' loss and gradient, Spark sums the
places that are not zero, and the driver, which holds weights of classes x places whatever the data, makes the step.
Rows of equal words and label are counted once with a weight.

``scorer`` makes a loader for ``models.score_rows``: label, its score and the scores of all classes, rounded.

Null and empty texts have no words: they are scored by the biases.  Rows without a label are left out of fitting.  An
empty table gives a model of equal scores for its classes.
"""
import dataclasses
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
KEPT = 10  # steps that L-BFGS remembers
ROWS = 256  # rows of an Arrow batch that a task works on at once


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places (ascending) and values of a text."""
    counts = {}
    for w in WORD.findall((text or "").lower()):
        counts[w] = counts.get(w, 0) + 1
    held = {}
    for w, n in counts.items():
        h = zlib.crc32(w.encode())
        held[h % (1 << bits)] = held.get(h % (1 << bits), 0.0) + (1 + math.log(n)) * (1 if h >> 31 else -1)
    at = np.array(sorted(held), np.int64)
    x = np.array([held[k] for k in at.tolist()])
    length = math.sqrt(float(x @ x)) if len(x) else 0.0
    return at, x / length if length else x


@dataclasses.dataclass
class Linear:
    """Weights (classes x places, the last one the bias)."""
    classes: list
    weights: np.ndarray
    bits: int = BITS
    losses: list = dataclasses.field(default_factory=list)

    def logits(self, text):
        at, x = features(text, self.bits)
        return self.weights[:, at] @ x + self.weights[:, -1]

    def scores(self, text):
        z = self.logits(text)
        e = np.exp(z - z.max())
        return e / e.sum()


def _summed(shipped, classes, bits):
    def summed(batches):
        weights = shipped.value
        gradient, loss = np.zeros_like(weights), 0.0
        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, len(b), ROWS)):
            label, at, x, n = batch.column(0).to_numpy(), batch.column(1), batch.column(2), batch.column(3).to_numpy()
            offsets, places, values = at.offsets.to_numpy(), at.values.to_numpy(), x.values.to_numpy()
            rows = np.repeat(np.arange(len(batch)), np.diff(offsets))
            places, values = places[offsets[0] : offsets[-1]], values[x.offsets[0].as_py() : x.offsets[-1].as_py()]
            z = np.stack([np.bincount(rows, weights=w[places] * values, minlength=len(batch)) for w in weights], 1) + weights[:, -1]
            z -= z.max(1, keepdims=True)
            log = z - np.log(np.exp(z).sum(1, keepdims=True))
            loss -= float(n @ log[np.arange(len(batch)), label])
            over = np.exp(log)
            over[np.arange(len(batch)), label] -= 1
            over *= n[:, None]
            for c in range(classes):
                gradient[c] += np.bincount(places, weights=over[rows, c] * values, minlength=gradient.shape[1])
            gradient[:, -1] += over.sum(0)
        used = np.flatnonzero(gradient.any(0))
        columns = [pa.array(np.concatenate([[-1], used]), pa.int64()), *(pa.array(np.concatenate([[loss if c == 0 else 0.0], gradient[c, used]])) for c in range(classes))]
        yield pa.RecordBatch.from_arrays(columns, names=["place", *(f"g{c}" for c in range(classes))])
    return summed


def _featured(bits):
    """Batches of (label, text, n) as small batches of (label, at, x, n), so that a task's memory doesn't grow with its rows."""
    def featured(batches):
        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, len(b), ROWS)):
            held = [features(t.as_py(), bits) for t in batch.column(1)]
            ends = pa.array(np.cumsum([0, *(len(at) for at, _ in held)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([h[k] for h in held]), kind)) for k, kind in ((0, pa.int32()), (1, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, batch.column(2)], names=["label", "at", "x", "n"])
    return featured


def prepared(df: DataFrame, text: str, label: str, classes: list, bits: int = BITS) -> DataFrame:
    """(label as its number, at, x, n): distinct rows of features with counts."""
    number = F.coalesce(*(F.when(F.col(label) == c, F.lit(i)) for i, c in enumerate(classes)))

    rows = df.select(number.cast("int").alias("label"), F.col(text).alias("text")).where("label is not null").groupBy("label", "text").agg(F.count("*").alias("n"))
    return rows.select("label", "text", "n").mapInArrow(_featured(bits), "label int, at array<int>, x array<double>, n long")


def loss_and_gradient(rows: DataFrame, weights: np.ndarray, total: float, decay: float, bits: int = BITS):
    """The mean loss with decay (not of biases) and its gradient, over rows of ``prepared``."""
    classes = len(weights)
    shipped = rows.sparkSession.sparkContext.broadcast(weights)
    kinds = "place long, " + ", ".join(f"g{c} double" for c in range(classes))
    sums = rows.mapInArrow(_summed(shipped, classes, bits), kinds).groupBy("place").agg(*(F.sum(f"g{c}").alias(f"g{c}") for c in range(classes))).collect()
    shipped.unpersist()
    gradient, loss = np.zeros_like(weights), 0.0
    for r in sums:
        if r["place"] < 0:
            loss = r["g0"]
        else:
            gradient[:, r["place"]] = r[1:]
    inner = weights.copy()
    inner[:, -1] = 0
    return loss / max(total, 1) + decay / 2 * float((inner * inner).sum()), gradient / max(total, 1) + decay * inner


def fit(df: DataFrame, text: str, label: str, classes: list, decay: float = 1e-4, rounds: int = 30, bits: int = BITS, enough: float = 1e-4) -> Linear:
    """A model of labelled texts; ``losses`` has the loss before each step.  Ends when no gradient is above ``enough``."""
    rows = prepared(df, text, label, classes, bits).persist(StorageLevel.DISK_ONLY)
    try:
        total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        weights = np.zeros((len(classes), (1 << bits) + 1))
        model = Linear(list(classes), weights, bits)
        if not total:
            return model
        value, slope = loss_and_gradient(rows, weights, total, decay, bits)
        steps = []
        for _ in range(rounds):
            model.losses.append(value)
            if np.abs(slope).max() <= enough:
                break
            way, back = -slope, []
            for s, y in reversed(steps):
                a = (s * way).sum() / (s * y).sum()
                way = way - a * y
                back.append(a)
            if steps:
                s, y = steps[-1]
                way = way * ((s * y).sum() / (y * y).sum())
            for (s, y), a in zip(steps, reversed(back)):
                way = way + s * (a - (y * way).sum() / (s * y).sum())
            down, stride = float((slope * way).sum()), 1.0 if steps else 1.0 / max(1.0, float(np.abs(slope).sum()))
            while True:
                moved = weights + stride * way
                new, steep = loss_and_gradient(rows, moved, total, decay, bits)
                if new <= value + 1e-4 * stride * down or stride < 1e-8:
                    break
                stride /= 2
            if new > value:
                break
            s, y = moved - weights, steep - slope
            if (s * y).sum() > 1e-12:
                steps = [*steps, (s, y)][-KEPT:]
            weights, value, slope = moved, new, steep
        model.weights = weights
        return model
    finally:
        rows.unpersist()


def scorer(model: Linear, digits: int = 4):
    """A loader for ``models.score_rows`` and its schema: label, score, scores (one for each class, in order)."""
    def load():
        def score(texts):
            out = []
            for t in texts:
                p = model.scores(t)
                best = int(p.argmax())
                out.append((model.classes[best], round(float(p[best]), digits), [round(float(v), digits) for v in p]))
            return out
        return score
    return load, "label string, score double, scores array<double>"
