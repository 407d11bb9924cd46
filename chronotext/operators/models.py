"""Model scoring as a table function, dictionary sentiment, topics, and registered functions.

A scorer is loaded once in each task and gets Arrow batches of texts.  Models themselves are plugged in.
"""
from collections.abc import Callable

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def score_rows(df: DataFrame, text: str, load: Callable, schema: str, batch: int = 64, longer_than: int = -1) -> DataFrame:
    """``load()`` gives a function from a list of texts to a list of rows of ``schema``; null and short texts get nulls.

    Columns of ``df`` are kept; those of ``schema`` must be new.  A task holds the texts and results of ``batch`` rows at a
    time beside the Arrow batch that it reads."""
    extra = T._parse_datatype_string(schema)
    kinds, at = to_arrow_schema(extra), df.columns.index(text)

    def run(batches):
        model = load()
        for part in (b.slice(a, batch) for b in batches for a in range(0, len(b), batch)):
            texts = part.column(at).to_pylist()
            rows = [(None,) * len(kinds)] * len(part)
            chosen = [i for i, t in enumerate(texts) if t is not None and len(t) > longer_than]
            for i, row in zip(chosen, model([texts[i] or " " for i in chosen]) if chosen else ()):
                rows[i] = tuple(row)
            made = [pa.array([r[k] for r in rows], kind.type) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *kinds.names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *extra.fields]))


SENT = 200_000  # terms of a lexicon that is sent to the tasks
BOOST = {"very": 0.293, "really": 0.293, "so": 0.293, "slightly": -0.293, "barely": -0.293}
NEGATIONS = ("not", "no", "never", "none", "nothing", "cannot", "can't", "don't", "isn't", "won't")


def sentiment(df: DataFrame, key, words: Column, lexicon: DataFrame) -> DataFrame:
    """Dictionary sentiment of rows of words: each entry's valence, boosted or turned by the three words before it,
    summed and brought to -1 to 1 (``compound``), and the shares of positive, negative and neutral words.

    ``lexicon`` (term, valence) has one row a term, and any number of them: up to ``SENT`` it is sent to the tasks, so that
    words stay where they are and a shuffled row is a text; a larger one is joined by term, with equal words of a text
    counted first.  Which one is found by a small job when the plan is built.  A row of the plan holds a word and what the
    three before it do to it, so the work is in proportion to the words, however long a text is."""
    keys, lexicon = list(key), lexicon.select("term", F.col("valence").cast("double"))
    near = F.transform(words, lambda w, i: F.struct(w.alias("term"), *(F.get(words, i - k).alias(f"w{k}") for k in (1, 2, 3))))
    before = F.array("w1", "w2", "w3")
    boost = F.lit(0.0)
    for w, b in BOOST.items():
        boost = boost + F.when(F.array_contains(before, w), b).otherwise(0.0)
    turned = F.arrays_overlap(F.filter(before, lambda w: w.isNotNull()), F.array(*map(F.lit, NEGATIONS)))
    rows = df.select(*keys, F.explode(near).alias("__near")).select(*keys, "__near.*")
    rows = rows.select(*keys, "term", boost.alias("__boost"), turned.alias("__turned"), F.lit(1).cast("long").alias("__n"))
    if lexicon.limit(SENT + 1).count() <= SENT:
        lexicon = F.broadcast(lexicon)
    else:
        rows = rows.groupBy(*keys, "term", "__boost", "__turned").agg(F.sum("__n").alias("__n"))
    value = (F.col("valence") + F.signum("valence") * F.col("__boost")) * F.when(F.col("__turned"), -0.74).otherwise(1.0)
    valued = rows.join(lexicon, "term", "left").withColumn("v", F.coalesce(value, F.lit(0.0)))
    total, n = F.sum(F.col("v") * F.col("__n")), F.sum("__n")
    part = lambda held: F.coalesce(F.sum(F.when(held, F.col("__n"))), F.lit(0)) / n
    return valued.groupBy(*keys).agg((total / F.sqrt(total * total + 15)).alias("compound"), part(F.col("v") > 0).alias("pos"), part(F.col("v") < 0).alias("neg"), part(F.col("v") == 0).alias("neu"))


def disagreement(a: Column, b: Column, least: float = 0.5) -> Column:
    """Opposite signs, and far apart."""
    return F.coalesce((F.signum(a) * F.signum(b) < 0) & (F.abs(a - b) >= least), F.lit(False))


def topics(df: DataFrame, key: str, words: Column, k: int = 10, vocabulary: int = 1 << 18, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Latent topics of rows: (key, topic, weight) and each topic's ten first words.

    The model holds k numbers a term on the driver, so only the ``vocabulary`` most frequent terms of two rows or more
    count; ``density.density_topics`` has no such bound, and outliers.  Counted rows are kept on disk while the model is
    fitted, since each of its steps reads them; of the vocabulary only each topic's first words go into a plan."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array
    rows = df.select(F.col(key), words.alias("__ws")).where(F.size("__ws") > 0)
    counter = CountVectorizer(inputCol="__ws", outputCol="features", vocabSize=vocabulary, minDF=2.0).fit(rows)
    counted = counter.transform(rows).select(key, "features").persist(StorageLevel.DISK_ONLY)
    try:
        model = LDA(k=k, seed=seed, maxIter=10, optimizer="online").fit(counted)
    finally:
        counted.unpersist()
    weights = vector_to_array("topicDistribution")
    best = F.array_max(F.transform(weights, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    assigned = model.transform(counter.transform(rows)).select(key, best["i"].alias("topic"), best["w"].alias("weight"))
    terms = counter.vocabulary
    named = df.sparkSession.createDataFrame([(r["topic"], [terms[i] for i in r["termIndices"]]) for r in model.describeTopics(10).collect()], "topic int, top_words array<string>")
    return assigned, named


def register_functions(spark: SparkSession) -> None:
    """Functions for SQL: mtld-like measures stay expressions, fuzzy ratios and HD-D are Arrow functions."""
    from ..functions.lexical import hdd, vocd
    from .linkage import partial_ratio, token_set_ratio
    for name, f in (("hdd", hdd), ("vocd", vocd), ("token_set_ratio", token_set_ratio), ("partial_ratio", partial_ratio)):
        spark.udf.register(name, f)
