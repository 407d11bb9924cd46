"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, decomposes characters and drops their marks, maps look-alike letters of other scripts and
digits or signs that stand for letters to one Latin letter, and turns the rest into spaces.  An entry starts at a
word's start; a weight is the log ratio of its document rates among toxic and clean rows.  Matches inside an
exception phrase do not count.  The weights' sum, alone and by the number of words, enters a logistic curve.

Null, empty and wordless texts match nothing and get the curve's value for no match.  Rows are scored one by one,
so repeated rows get equal scores; an empty table gives an empty result; only id and text are read.  Without
labelled rows of both classes the lexicon is empty and every score is the smoothed share of toxic rows.

The lexicon is fitted on at most ``max_toxic`` and ``max_clean`` labelled rows, those of the smallest hash.
"""
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

MAX_TOXIC, MAX_CLEAN = 4_000, 12_000
LONGEST_ENTRY = 12
MIN_ROWS, MIN_WEIGHT, SURE, KEPT = 5, 2.0, 2.75, 0.9

# Letters of other scripts that look like Latin ones, pairwise.
LOOK_ALIKES = str.maketrans("аеорсухіјѕԁһѵвкмнтгпιοαρνυκτεβσχωɑɡıℓßøđłæœ", "aeopcyxijsdhvbkmhtrnioapvuktebsxwagilsodlao")
MARKS = re.compile("[̀-ͯ]+")
TRAILING_SIGNS = re.compile(rb"[$@|!]+(?![a-z0-9])")


def _byte_table():
    table = bytearray(b" " * 256)
    for c in range(0x61, 0x7B):
        table[c] = c
    # i, l, 1, | and ! are one letter; so are o and 0, and so on.
    for a, b in zip(b"l1|!03457@$92", b"iiiioeastasqz"):
        table[a] = b
    return bytes(table)


BYTE_TABLE = _byte_table()


def fold(text):
    """Folded text between spaces: only a to z and spaces."""
    text = text.lower()
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text)).translate(LOOK_ALIKES)
    data = text.encode("ascii", "replace")
    if b"$" in data or b"@" in data or b"|" in data or b"!" in data:
        data = TRAILING_SIGNS.sub(b" ", data)
    return " " + data.translate(BYTE_TABLE).decode() + " "


class Scorer:
    """Sum of the weights of the entries in a text, without those inside exception phrases, and the number of words."""

    def __init__(self, weights, exceptions=()):
        import ahocorasick
        self.machine = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.machine.add_word(" " + entry, (weight, len(entry) + 1))
        self.exempt = ahocorasick.Automaton()
        for phrase in exceptions:
            self.exempt.add_word(" " + phrase, len(phrase) + 1)
        for machine in (self.machine, self.exempt):
            if len(machine):
                machine.make_automaton()

    def hits(self, folded):
        """(start, end, weight) of the counted matches: the longest entry that starts at a place."""
        if not len(self.machine):
            return []
        best = {}
        for end, (weight, size) in self.machine.iter(folded):
            best[end + 1 - size] = (end + 1, weight)
        if best and len(self.exempt):
            covered = [(end + 1 - size, end + 1) for end, size in self.exempt.iter(folded)]
            best = {a: v for a, v in best.items() if not any(x <= a and v[0] <= y for x, y in covered)}
        return [(a, *v) for a, v in sorted(best.items())]

    def __call__(self, text):
        folded = fold(text)
        return sum(w for _, _, w in self.hits(folded)), len(folded.split())


def features(total, words):
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(1000 * total / np.maximum(words, 1))], axis=1)


def _entries(text):
    out = set()
    for word in set(fold(text).split()):
        out.update(word[:n] for n in range(3, min(len(word), LONGEST_ENTRY) + 1))
    return out


def _count_entries(batches):
    counts = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for entry in _entries(text or ""):
                both = counts.setdefault(entry, [0, 0])
                both[toxic] += 1
    names = list(counts)
    for at in range(0, len(names), 20_000):
        part = names[at : at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([counts[x][k] for x in part], pa.int64()) for k in (0, 1))], names=["entry", "clean", "toxic"])


def choose_entries(counts, n_clean, n_toxic):
    """{entry: weight} from {entry: (clean rows, toxic rows)}.

    Entries are taken in the order of their toxic rows times their weight, if their weight is large against its
    standard error, and lengthened while one longer entry keeps nearly all toxic rows; no entry begins another one.
    """
    def weight(e):
        return np.log((counts[e][1] + 0.5) / (n_toxic + 1)) - np.log((counts[e][0] + 0.5) / (n_clean + 1))

    def good(e):
        clean, toxic = counts[e]
        return toxic >= MIN_ROWS and weight(e) >= max(MIN_WEIGHT, SURE * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)))

    longer = {}
    for e in counts:
        longer.setdefault(e[:-1], []).append(e)
    out, begun = {}, set()
    for e in sorted(filter(good, counts), key=lambda e: (-counts[e][1] * weight(e), e)):
        if e not in begun and not any(e[:n] in out for n in range(3, len(e) + 1)):
            while longest := [x for x in longer.get(e, ()) if counts[x][1] >= KEPT * counts[e][1] and good(x)]:
                e = longest[0]
            out[e] = float(weight(e))
            begun.update(e[:n] for n in range(3, len(e)))
    return out


def _contexts(weights):
    def contexts(batches):
        scorer = Scorer(weights.value)
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = fold(text or "")
                for start, _, _ in scorer.hits(folded):
                    before, after = folded[max(0, start - 40) : start].split(), folded[start : start + 80].split()
                    rows += [(" ".join(before[-1:] + after[:1]), toxic)] * bool(before) + [(" ".join(after[:2]), toxic)] * (len(after) > 1)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["phrase", "toxic"])
    return contexts


def fit_curve(x, y, ridge=1e-2):
    """Logistic regression by Newton's steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs, labels, doc_id="doc_id", text="text", label="toxic", max_toxic=MAX_TOXIC, max_clean=MAX_CLEAN):
    """A model {weights, exceptions, curve} from documents and the labels given; equal texts count once."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    order = [F.xxhash64("__id"), F.col("__id")]
    picked = known.where("__y = 1").orderBy(*order).limit(max_toxic).unionAll(known.where("__y = 0").orderBy(*order).limit(max_clean))
    picked = spark.createDataFrame(picked.collect(), known.schema)  # at most max_toxic + max_clean ids
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(picked), "__id").where(F.col("__text").isNotNull())
    from .store import stored
    sample = stored(rows.groupBy("__text").agg(F.max("__y").alias("__y")), "labelled")  # toxic where equal texts disagree
    sizes = {r[0]: r[1] for r in sample.groupBy("__y").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        share = (n_toxic + 0.5) / (n_clean + n_toxic + 1)
        return {"weights": {}, "exceptions": [], "curve": [float(np.log(share / (1 - share))), 0.0, 0.0]}
    counted = sample.mapInArrow(_count_entries, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Entries that can't be accepted stay on the executors.
    kept = counted.where((F.col("toxic") >= MIN_ROWS) & (F.col("toxic") * (n_clean + 1) >= F.col("clean") * (n_toxic + 1)))
    weights = choose_entries({r[0]: (r[1], r[2]) for r in kept.collect()}, n_clean, n_toxic)
    shipped = spark.sparkContext.broadcast(weights)
    around = sample.mapInArrow(_contexts(shipped), "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    exceptions = sorted(r[0] for r in around.where("t = 0 and n >= 10").collect())
    model = {"weights": weights, "exceptions": exceptions, "curve": [0.0, 0.0, 0.0]}
    scored = sample.select(F.lit(0).alias("id"), "__text", "__y").mapInArrow(_sums(spark.sparkContext.broadcast(model)), "total double, words long, toxic int").collect()
    total, words, y = (np.array([r[k] for r in scored], dtype=float) for k in range(3))
    model["curve"] = fit_curve(features(total, words), y).tolist()
    return model


def _sums(model):
    def sums(batches):
        scorer = Scorer(model.value["weights"], model.value["exceptions"])
        for batch in batches:
            got = [scorer(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), batch.column(2)], names=["total", "words", "toxic"])
    return sums


def _score(model):
    def score(batches):
        scorer, curve = Scorer(model.value["weights"], model.value["exceptions"]), np.array(model.value["curve"])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = [scorer(t or "") for t in part.column(1).to_pylist()]
                total, words = (np.array([g[k] for g in got], dtype=float) for k in (0, 1))
                value = 1 / (1 + np.exp(-np.clip(features(total, words) @ curve, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total), pa.array(words.astype(np.int64)), pa.array(value)], names=["doc_id", "weight", "n_words", "score"])
    return score


def score(docs, model, doc_id="doc_id", text="text"):
    """One row per document: doc_id, weight (of the matched entries), n_words (folded) and score."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_score(shipped), f"doc_id {kind}, weight double, n_words long, score double")


def remainder(column):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5))


def op10_toxicity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where(remainder("doc_id") != 0))
    return score(docs, model).select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
