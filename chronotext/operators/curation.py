"""Curated selections: best lines per bucket, themed picks, exemplars, mention rates and summaries."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import signature, skeleton, squeeze


def curated(rows: DataFrame, title: str, text: str, value: str, bucket: str, ok: Column, caps: dict, total: int, ties=()) -> DataFrame:
    """The best row of each title and text (case and spaces don't matter) that is ``ok``; of each bucket in ``caps`` its best
    rows, of all others any number; once per title and skeleton, in the order of the buckets, up to ``total`` rows.
    ``ties`` are columns that order rows of equal value, title and text, whose buckets may differ."""
    order = [F.desc(value), title, text, *ties]
    best = Window.partitionBy(title, F.lower(squeeze(F.col(text)))).orderBy(*order)
    once = rows.withColumn("__n", F.row_number().over(best)).where("__n = 1").where(F.coalesce(ok, F.lit(False)))
    place = F.lit(len(caps))
    for i, name in reversed(list(enumerate(caps))):
        place = F.when(F.col(bucket) == name, i).otherwise(place)
    placed = once.withColumn("__place", place)
    # A bucket's best are a sort with a limit, which each task applies first; the buckets without a cap need no ranks.
    ranked = placed.where(F.col("__place") == len(caps))
    for i, most in enumerate(caps.values()):
        ranked = ranked.unionAll(placed.where(F.col("__place") == i).orderBy(*order).limit(min(most, total)))
    first = Window.partitionBy(title, skeleton(F.col(text))).orderBy("__place", *order)
    distinct = ranked.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    # The limit comes before the ranks: no window goes over all rows.
    few = distinct.orderBy("__place", *order).limit(total)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__place", *order))).select(*rows.columns, "rank")


def themed_pick(rows: DataFrame, group: str, text: str, value: str, share: Column, flags, n: int = 3, strict: float = 0.4, relaxed: float = 0.5) -> DataFrame:
    """Per group n rows of different signatures: those with the earlier of ``flags`` (boolean columns) first, then by value.
    Rows have a ``share`` of at most ``strict``; if any group then has fewer than n, ``relaxed`` holds for all."""
    marks = [F.when(F.coalesce(f, F.lit(False)), 0).otherwise(1) for f in flags]
    order = [*marks, F.desc(value), text]

    def pick(bound):
        kept = rows.where(share <= bound)
        once = kept.withColumn("__n", F.row_number().over(Window.partitionBy(group, signature(F.col(text))).orderBy(*order))).where("__n = 1")
        return once.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n).drop("__n").withColumn("bound", F.lit(bound))

    both = pick(strict).unionByName(pick(relaxed))
    short = rows.select(group).distinct().join(pick(strict).groupBy(group).agg(F.count("*").alias("__k")), group, "left").where(F.coalesce("__k", F.lit(0)) < n)
    chosen = short.agg(F.when(F.count("*") > 0, relaxed).otherwise(strict).alias("__bound"))
    return both.join(F.broadcast(chosen), F.col("bound") == F.col("__bound")).drop("__bound")


def exemplars(rows: DataFrame, day: str, text: str, words: Column, windows, ok: Column, k: int = 5) -> DataFrame:
    """Per window (name, first day, last day, whether the shortest come first) its k shortest or longest lines."""
    listed = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b"), F.lit(short).alias("short")) for n, a, b, short in windows])
    spread = rows.where(F.coalesce(ok, F.lit(False))).withColumns({"n_words": F.size(words), "n_distinct": F.size(F.array_distinct(words))}).withColumn("__w", F.explode(listed))
    inside = spread.where(F.to_date(day).between(F.col("__w.a"), F.col("__w.b")))
    size = F.when(F.col("__w.short"), F.col("n_words")).otherwise(-F.col("n_words"))
    return inside.withColumn("rank", F.row_number().over(Window.partitionBy("__w.window").orderBy(size, text))).where(F.col("rank") <= k).withColumn("window", F.col("__w.window")).drop("__w")


def summary(rows: DataFrame, category: str, words: Column, marked: Column) -> DataFrame:
    """Rows per category, their mean words, and the percentage that is marked."""
    return rows.groupBy(category).agg(F.count("*").alias("n"), F.avg(F.size(words)).alias("mean_words"), (100 * F.avg(F.coalesce(marked, F.lit(False)).cast("int"))).alias("pct_marked"))


def mention_rates(rows: DataFrame, keys, names: Column, targets: dict) -> DataFrame:
    """Per key and target the rows per 1,000 whose names hold one of the target's (case doesn't matter)."""
    lowered = F.transform(F.coalesce(names, F.array().cast("array<string>")), F.lower)
    hits = [F.arrays_overlap(lowered, F.array(*[F.lit(n.lower()) for n in needles])) for needles in targets.values()]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.count_if(h).alias(f"__h{i}") for i, h in enumerate(hits)])
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"__h{i}").alias("n_hits")) for i, t in enumerate(targets)])).alias("__p")
    return counts.select(*keys, "n_rows", pairs).select(*keys, "__p.target", "__p.n_hits", (1000.0 * F.col("__p.n_hits") / F.col("n_rows")).alias("rate"))


def trajectory(similarities: DataFrame, period: str, theme: str, similarity: str) -> DataFrame:
    """Mean similarity and rows per period and theme."""
    return similarities.groupBy(period, theme).agg(F.avg(similarity).alias("mean_similarity"), F.count(similarity).alias("n"))


def ordered_distinct(rows: DataFrame, keys, value: str, ordinal: str) -> DataFrame:
    """Each value once, in the order of its first place."""
    first = rows.groupBy(*keys, value).agg(F.min(ordinal).alias(ordinal))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal, value)))


def cluster_votes(rows: DataFrame, keys, flag: Column) -> DataFrame:
    """ALL, SOME or NONE of a group's rows (nulls count as false)."""
    known = F.coalesce(flag, F.lit(False))
    return rows.groupBy(*keys).agg(F.bool_and(known).alias("every"), F.bool_or(known).alias("any")).withColumn("label", F.when(F.col("every"), "ALL").when(F.col("any"), "SOME").otherwise("NONE"))
