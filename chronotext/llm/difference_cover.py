"""The suffix array of a whole corpus by the difference cover modulo 3, every step of it a distributed sort or join.

* ``symbols`` lays all texts end to end: a row a byte, with its place in the corpus; a terminator ends each text.
* ``suffix_ranks`` sorts the triples of symbols at places 1 and 2 modulo 3 and names them by the place of their sort; if
  names repeat it recurses on the string of names.  The remaining suffixes (0 modulo 3) are merged by two sorts: with
  those of 1 by (symbol, next rank), with those of 2 by (two symbols, rank after them).  A suffix's rank is its place
  among its like, and how many of the others lie before it.  Up to ``base`` symbols are sorted in one task.
* ``repeated_places`` compares each suffix with the next in rank: places whose first ``length`` bytes, known by a 64-bit
  hash, equal a neighbour's start a repeated string.

Sorts are ranges of the cluster's partitions; places come from the partitions' counts.  Null is the empty text; an empty
table gives an empty result; texts are taken as they are, equal ones too; other columns aren't read.

``op6_suffix_dedup`` doesn't go this way: every level sorts and joins a row a byte.  README has the measured figures.
"""
import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from .arrays import Rolling, text_slices
from .store import discard, stored
from .suffix_dedup import suffix_array

BASE = 262_144


def ranked(df, keys, weight):
    """Rows with ``place``, the number of rows before them in the order of the keys, and ``before``, the weight of these."""
    def running(batches):
        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sums = batch[weight].to_numpy().cumsum()
            yield batch.assign(__part=part, __place=rows + np.arange(len(batch)), __before=total + sums - batch[weight].to_numpy())
            rows, total = rows + len(batch), total + (int(sums[-1]) if len(sums) else 0)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    held = stored(df.orderBy(*keys).mapInPandas(running, f"{kinds}, __part int, __place long, __before long"), "ranked")
    ends = held.groupBy("__part").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))  # one row a partition
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("__w"))
    out = held.join(F.broadcast(ends), "__part").select(*df.columns, (F.col("__place") + F.col("__n")).alias("place"), (F.col("__before") + F.col("__w")).alias("before"))
    out.held = held
    return out


def _in_one_task(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("p")
    rank = np.empty(len(rows), np.int64)
    rank[suffix_array(rows["c"].to_numpy())] = np.arange(len(rows))
    return pd.DataFrame({"p": rows["p"].to_numpy(), "r": rank})


def _triples(symbols):
    """(p, c0, c1, c2): each place with its symbol and the two after it, 0 beyond the end."""
    sent = symbols.select("c", F.explode(F.array(*[F.struct((F.col("p") - k).alias("p"), F.lit(k).alias("k")) for k in range(3)])).alias("x")).select("x.p", "x.k", "c").where("p >= 0")
    return sent.groupBy("p").agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("c"))), F.lit(0)).alias(f"c{k}") for k in range(3)])


def suffix_ranks(symbols, n, base=BASE, levels=None):
    """(p, r): the rank, from 0, of the suffix at each place p from 0 to n - 1 of symbols (p, c) from 1."""
    if levels is not None:
        levels.append(n)
    if n <= base:
        return symbols.groupBy().applyInPandas(_in_one_task, "p long, r long") if n else symbols.select("p", F.col("c").alias("r"))
    spark = symbols.sparkSession
    triples = stored(_triples(symbols), "triples")
    sample = triples.where("p % 3 <> 0")
    if n % 3 == 1:  # an end place in the sample keeps the two parts of the names apart
        sample = sample.unionAll(spark.createDataFrame([(n, 0, 0, 0)], "p long, c0 long, c1 long, c2 long"))
    key = ["c0", "c1", "c2"]
    names = ranked(sample.groupBy(*key).agg(F.count("*").alias("rows")), key, "rows")
    named = stored(sample.join(names, key).select("p", (F.col("place") + 1).alias("c")), "named")
    size, ones = 2 * (n // 3) + (n % 3 == 2) + (n % 3 == 1), (n + 1) // 3 + (n % 3 == 1)
    if names.held.count() == size:
        ranks = named.select("p", F.col("c").alias("r"))
    else:
        third = F.floor(F.col("p") / 3)
        inner = suffix_ranks(named.select(F.when(F.col("p") % 3 == 1, third).otherwise(third + ones).alias("p"), "c"), size, base, levels)
        ranks = inner.select(F.when(F.col("p") < ones, F.col("p") * 3 + 1).otherwise((F.col("p") - ones) * 3 + 2).alias("p"), (F.col("r") + 1).alias("r"))
    ranks = stored(ranks, "ranks")

    def merged(kind, keys):
        """Suffixes of 0 and ``kind`` modulo 3 in order."""
        ahead = ranks.select((F.col("p") - kind).alias("p"), F.col("r").alias("ahead"))
        both = triples.where(F.col("p") % 3 != 3 - kind).join(ahead, "p", "left").select("p", *keys, F.coalesce("ahead", F.lit(0)).alias("ahead"), (F.col("p") % 3 != 0).cast("long").alias("in_sample"))
        return ranked(both, [*keys, "ahead"], "in_sample")

    first, second = merged(1, ["c0"]), merged(2, ["c0", "c1"])
    rest = first.where("in_sample = 0").select("p", "place").join(second.where("in_sample = 0").select("p", "before"), "p").select("p", (F.col("place") + F.col("before")).alias("r"))
    others = first.unionByName(second, allowMissingColumns=True).where("in_sample = 1").select("p", (F.col("place") - F.col("before")).alias("less"))
    out = stored(rest.unionAll(others.join(ranks, "p").select("p", (F.col("r") - 1 - int(n % 3 == 1) + F.col("less")).alias("r"))), "suffixes")
    discard(triples, names.held, named, ranks, first.held, second.held)
    return out


def laid(docs, doc_id="doc_id", text="text"):
    """(id, text, start): texts with their places in the corpus, a terminator behind each."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.encode(text, "utf-8"), F.lit(b"")).alias("text")).withColumn("size", F.length("text").cast("long") + 1)
    return ranked(rows, ["id"], "size").select("id", "text", F.col("before").alias("start"), "size")


def _symbols(batches):
    for batch in batches:
        for start, data in zip(batch["start"], batch["text"]):
            c = np.concatenate([np.frombuffer(data, np.uint8).astype(np.int64) + 2, [1]])
            for at in range(0, len(c), 1 << 18):
                part = c[at : at + (1 << 18)]
                yield pd.DataFrame({"p": start + at + np.arange(len(part)), "c": part})


def symbols(texts):
    return texts.select("start", "text").mapInPandas(_symbols, "p long, c long")


def _windows(length):
    import pyarrow as pa

    def windows(batches):
        rolling = Rolling()
        for batch in batches:
            starts = batch.column(0).to_numpy()
            for first, end, buf, offsets in text_slices(batch.column(1)):
                prefix = rolling.prefix(buf)
                for i in range(end - first):
                    at = np.arange(offsets[i], offsets[i + 1] - length + 1)
                    if len(at):
                        hashes = rolling.spans(prefix, at, at + length).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(starts[first + i] + at - offsets[i]), pa.array(hashes)], names=["p", "h"])
    return windows


def repeated_places(docs, length, doc_id="doc_id", text="text", base=BASE, levels=None):
    """(p): places in the corpus of ``laid(docs)`` at which a string of ``length`` bytes starts that starts elsewhere too."""
    texts = stored(laid(docs, doc_id, text), "laid")
    n = texts.agg(F.sum("size")).first()[0] or 0
    ranks = suffix_ranks(symbols(texts), n, base, levels)
    hashes = texts.select("start", "text").mapInArrow(_windows(length), "p long, h long")
    held = stored(ranks.join(hashes, "p").select("p", "r", "h"), "hashes")
    # Between two suffixes of equal first bytes lie only such suffixes, so neighbours in rank are enough.
    follows = held.select((F.col("r") - 1).alias("r"), F.col("p").alias("q"), F.col("h").alias("g"))
    pairs = held.join(follows, "r").where("h = g")
    return pairs.select(F.explode(F.array("p", "q")).alias("p")).distinct(), texts
