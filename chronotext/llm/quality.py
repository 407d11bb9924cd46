"""Quality classifier: a weak-label model and a hashed linear scorer.

Heuristic labellers vote good, bad or abstain on each text.  Expectation-maximisation estimates from the counts of all
vote patterns how often each labeller votes so for good texts and for those bad in one way or another, and the shares of
these classes; no true labels are used.  The posterior of a text's pattern is its soft label.  A logistic scorer over hashed features (word shapes,
pairs of shapes, buckets of the measures that labellers look at) is fitted to the soft labels of at most
``SAMPLE`` distinct texts, those of the smallest hash, and scores every text.

Null and empty texts have no words: their labellers abstain and they get the scorer's value for no features.  Equal
texts get equal scores and are one text of the sample; ids, which may be null or repeated, play no part.  With no
documents the model is neutral (score 0.5).  Only id and text are read; ``keep`` carries all columns through (names that
begin with ``__quality_`` are reserved).
"""
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import lean
from .store import stored

DIMENSIONS = 2048
SAMPLE = 6_000
SYMBOLS = b"#&$%*|!@^~<>{}[]=+\\_"
UPPER = bytes(range(0x41, 0x5B))
# (labeller, measure, bad if below, good from, good to, bad if above); None: no such vote
LABELLERS = [
    ("symbols", 0, None, 0.0, 0.004, 0.03),
    ("capitals", 1, None, 0.0, 0.12, 0.30),
    ("compression", 2, 0.36, 0.42, 9.0, None),
    ("repeats", 3, None, 0.0, 0.02, 0.10),
    ("lines", 4, None, 0.0, 0.10, 0.30),
    ("distinct", 5, 0.30, 0.50, 1.0, None),
    ("length", 6, 2.0, 3.0, 8.0, 12.0),
]
GOOD, BAD = 2, 1
SURE, ALARM = 0.8, 0.02
HASHES = 1 << 62
MADE = ["__quality_hash", "__quality_pattern", "__quality_at", "__quality_value"]


def measures(data, words):
    """Shares of symbols and capitals, compressed size, neighbouring equal words, repeated lines, distinct words of the
    first-to-last thousands, and mean word length."""
    n = max(len(data), 1)
    symbols = n - len(data.translate(None, SYMBOLS)) if data else 0
    capitals = n - len(data.translate(None, UPPER)) if data else 0
    packed = len(zlib.compress(data, 1)) / n if len(data) >= 200 else 1.0
    k = len(words)
    equal = sum(a == b for a, b in zip(words, words[1:])) / max(k - 1, 1)
    lines = [x for x in data.replace(b". ", b".\n").split(b"\n") if len(x) > 3]
    repeated = 1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0
    parts = [len(set(words[i : i + 1000])) / len(words[i : i + 1000]) for i in range(0, k, 1000) if len(words[i : i + 1000]) >= min(k, 500)] if k >= 20 else [1.0]
    return [symbols / n, capitals / n, packed, equal, repeated, sum(parts) / len(parts), len(data) / max(k, 1) if k else 5.0]


def votes(values):
    out = []
    for _, m, low, start, stop, high in LABELLERS:
        v = values[m]
        out.append(BAD if (low is not None and v < low) or (high is not None and v > high) else GOOD if start <= v <= stop else 0)
    return out


def pattern_of(v):
    return int(sum(x * 3**k for k, x in enumerate(v)))


def shape(word):
    """A number for a word's letters' case, length and signs, from its bytes."""
    text = word.decode()
    letters = text.strip(".,;:!?\"'()-")
    case = 0 if letters.islower() else 1 if letters.istitle() else 2 if letters.isupper() else 3 if letters.isdigit() else 4
    signs = text[len(letters) :] if text.startswith(letters) else "?"
    return zlib.crc32(f"{case} {min(len(letters), 12)} {signs[:3]}".encode())


class Shapes(dict):
    def __missing__(self, word):
        got = shape(word)
        if len(self) >= 300_000:
            self.clear()
        self[word] = got
        return got


def features(words, values, shapes):
    """Sorted hashed positions and their values of one text."""
    if words:
        s = np.array([shapes[w] for w in words], dtype=np.int64)
        counts = np.bincount(s % 1021, minlength=1021) + 0.0
        pairs = np.bincount((s[:-1] * 31 + s[1:]) % 967, minlength=967)
        at, bt = np.flatnonzero(counts), np.flatnonzero(pairs)
        values_ = np.sqrt(np.concatenate([counts[at], pairs[bt]]) / len(words))
        at = np.concatenate([at, 1021 + bt])
    else:
        at, values_ = np.empty(0, np.int64), np.empty(0)
    buckets = [1988 + (zlib.crc32(f"{m} {int(20 * min(v, 3.0)) if m != 6 else int(v)}".encode()) % 60) for m, v in enumerate(values)] if words else []
    return np.concatenate([at, np.array(buckets, dtype=np.int64)]), np.concatenate([values_, np.ones(len(buckets))])


def _profiles(text_at, carried):
    def profiles(batches):
        shapes = Shapes()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                patterns, at, values = [], [], []
                for text in part.column(text_at):
                    data = (text.as_py() or "").encode()
                    words = data.split()
                    m = measures(data, words)
                    patterns.append(pattern_of(votes(m)) if words else 0)
                    a, v = features(words, m, shapes)
                    at.append(a.astype(np.int32))
                    values.append(v.astype(np.float32))
                bounds = pa.array(np.concatenate([[0], np.cumsum([len(a) for a in at])]), pa.int32())
                added = [pa.array(patterns, pa.int32()), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(at))), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(values)))]
                columns = [part.column(i) for i in carried]
                yield pa.RecordBatch.from_arrays([*columns, *added], names=[*(part.schema.names[i] for i in carried), *MADE[1:]])
    return profiles


def profiles(docs, text="text", carry=("doc_id",)):
    """The columns ``carry`` and, computed once for each row and stored, a hash of its text, its vote pattern and its
    features (``MADE``)."""
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(HASHES - 1)
    source = docs.select(*dict.fromkeys([*carry, text])).withColumn(MADE[0], hashed)
    carried = [source.columns.index(c) for c in (*carry, MADE[0])]
    schema = T.StructType([source.schema[i] for i in carried])
    for name, kind in zip(MADE[1:], (T.IntegerType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.FloatType()))):
        schema.add(name, kind)
    return stored(source.mapInArrow(lean(_profiles(source.columns.index(text), carried)), schema), "quality")


def expectation_maximisation(patterns, rounds=60):
    """(shares of the classes, vote rates by class, labeller and vote, {pattern: posterior of good}).

    Class 0 is good; there is a bad class for each labeller, since a text is rarely bad in every way.  In a labeller's
    class it votes bad with a rate of ``SURE`` at least; in the good class none votes bad above ``ALARM``.
    """
    k = len(LABELLERS)
    keys = np.array(sorted(patterns), dtype=np.int64)
    n = np.array([patterns[p] for p in keys.tolist()], dtype=float)
    v = np.stack([keys // 3**j % 3 for j in range(k)], axis=1) if len(keys) else np.zeros((0, k), np.int64)
    start = np.empty((k + 1, k, 3))
    start[0], start[1:] = (0.09, 0.01, 0.9), (0.3, 0.1, 0.6)
    for j in range(k):
        start[j + 1, j] = (0.05, 0.9, 0.05)
    rates, shares = start.copy(), np.array([0.8, *[0.2 / k] * k])
    q = np.zeros((k + 1, len(keys)))
    for _ in range(rounds):
        log = np.log(shares)[:, None] + sum(np.log(rates[:, j, v[:, j]]) for j in range(k))
        q = np.exp(log - log.max(axis=0, keepdims=True))
        q /= q.sum(axis=0, keepdims=True)
        weight = q * n
        shares = (weight.sum(axis=1) + 1) / (n.sum() + k + 1)
        for c in range(k + 1):
            for j in range(k):
                seen = np.bincount(v[:, j], weights=weight[c], minlength=3) + start[c, j]
                seen /= seen.sum()
                bound = min(seen[BAD], ALARM) if c == 0 else max(seen[BAD], SURE) if c == j + 1 else seen[BAD]
                rest = seen[[0, GOOD]] / seen[[0, GOOD]].sum() * (1 - bound)
                rates[c, j] = rest[0], bound, rest[1]
    return shares, rates, dict(zip(keys.tolist(), q[0].tolist()))


def fit_scorer(rows, targets, ridge=1e-3, rounds=400):
    """Weights and bias of a logistic scorer by accelerated gradient steps; rows: (positions, values)."""
    x = np.zeros((len(rows), DIMENSIONS), dtype=np.float32)
    for i, (at, value) in enumerate(rows):
        np.add.at(x[i], at, value)
    y = np.asarray(targets, dtype=np.float32)
    w, b, vw, vb = np.zeros(DIMENSIONS, np.float32), 0.0, 0.0, 0.0
    # Both classes weigh the same.
    good = y.sum() / max(len(y), 1)
    weight = np.where(y > 0.5, 0.5 / max(good, 1e-3), 0.5 / max(1 - good, 1e-3)).astype(np.float32) / max(len(y), 1)
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        d = (p - y) * weight
        vw, vb = 0.9 * vw - 0.3 * (x.T @ d + ridge * w), 0.9 * vb - 0.3 * d.sum()
        w, b = w + vw, b + vb
    return w, float(b)


def chosen(made, sample, rows):
    """Features and patterns of the ``sample`` distinct texts of the smallest hashes."""
    name, pattern, at, value = MADE
    share = 1.5 * sample / max(rows, 1)
    while True:
        near = made if share >= 1 else made.where(F.col(name) <= F.lit(int(share * HASHES)))
        got = near.groupBy(name).agg(F.first(pattern).alias("pattern"), F.first(at).alias("at"), F.first(value).alias("value"))
        if share >= 1 or got.count() >= sample:
            return got.orderBy(name).limit(sample).select("pattern", "at", "value").collect()
        share *= 4  # many rows are copies


def fit(made, sample=SAMPLE):
    """The model {shares, rates, posterior, weights, bias} from stored profiles."""
    patterns = {r[0]: r[1] for r in made.groupBy(MADE[1]).count().collect()}
    shares, rates, posterior = expectation_maximisation(patterns)
    rows = chosen(made, sample, sum(patterns.values()))
    weights, bias = fit_scorer([(r[1], r[2]) for r in rows], [posterior[r[0]] for r in rows])
    return {"shares": shares, "rates": rates, "posterior": posterior, "weights": weights, "bias": bias}


def _scores(model, threshold):
    """The carried columns with posterior and score, or those of the rows that reach the threshold."""
    def scores(batches):
        w, b, posterior = model.value["weights"].astype(float), model.value["bias"], model.value["posterior"]
        for batch in batches:
            k = batch.num_columns - len(MADE)
            at, value = batch.column(k + 2), batch.column(k + 3)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
            total = np.bincount(owner, weights=w[at.flatten().to_numpy()] * value.flatten().to_numpy(), minlength=batch.num_rows) + b
            score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            columns, names = batch.columns[:k], batch.schema.names[:k]
            if threshold is None:
                weak = pa.array([posterior[p] for p in batch.column(k + 1).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*columns, weak, pa.array(score)], names=[*names, "posterior", "score"])
            else:
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(score >= threshold))
    return scores


def score(made, model, threshold=None):
    """The carried columns with posterior (weak label) and score of stored profiles; with a threshold, the carried
    columns alone of the rows that reach it."""
    schema = T.StructType(made.schema.fields[: -len(MADE)])
    if threshold is None:
        schema = schema.add("posterior", T.DoubleType()).add("score", T.DoubleType())
    return made.mapInArrow(lean(_scores(made.sparkSession.sparkContext.broadcast(model), threshold)), schema)


def keep(docs, text="text", threshold=0.5):
    """The documents whose score reaches the threshold, with all their columns."""
    made = profiles(docs, text, docs.columns)
    return score(made, fit(made), threshold)


def op9_quality(spark, sf_dir):
    made = profiles(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return score(made, fit(made)).select("doc_id", "posterior", "score", (F.col("score") >= 0.5).alias("keep"))
