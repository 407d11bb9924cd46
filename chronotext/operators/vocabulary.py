"""Vocabulary: term counts, distinctive terms and log-odds, over exploded tokens with map-side counting."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_counts(df: DataFrame, keys, words: Column) -> DataFrame:
    return df.select(*keys, F.explode(words).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def top_terms(counts: DataFrame, keys, k: int, stop_words=(), longer_than: int = 2) -> DataFrame:
    """The most frequent terms; the smaller term on a tie."""
    kept = counts.where((F.length("term") > longer_than) & ~F.col("term").isin(*stop_words) if stop_words else F.length("term") > longer_than)
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "term")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tfidf(counts: DataFrame, key: str, k: int, stop_words=(), widest: float = 0.85, least: int = 1) -> DataFrame:
    """Terms of each group by (1 + ln(tf)) * (ln((1 + N) / (1 + df)) + 1), scaled to length 1 within a group; groups are
    documents.  Stop words go, and terms in more than ``widest`` of all groups."""
    kept = counts.where(F.col("n") >= least)
    kept = kept.where(~F.col("term").isin(*stop_words)) if stop_words else kept
    groups = counts.agg(F.count_distinct(key).alias("groups"))
    spread = kept.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(groups)).where(F.col("df") <= widest * F.col("groups"))
    weighed = kept.join(spread, "term").withColumn("w", (1 + F.log("n")) * (F.log((1 + F.col("groups")) / (1 + F.col("df"))) + 1))
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scored = weighed.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("tfidf"))
    ranked = Window.partitionBy(key).orderBy(F.desc(F.round("tfidf", 9)), "term")
    return scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def log_odds(left: DataFrame, right: DataFrame) -> DataFrame:
    """Smoothed log ratio of a term's rates in two counters (term, n), over their joint vocabulary."""
    both = left.select("term", F.col("n").alias("a")).join(right.select("term", F.col("n").alias("b")), "term", "full").select("term", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    totals = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count("*").alias("v"))
    odds = F.log((F.col("a") + 1) / (F.col("ta") + F.col("v"))) - F.log((F.col("b") + 1) / (F.col("tb") + F.col("v")))
    return both.crossJoin(F.broadcast(totals)).select("term", "a", "b", odds.alias("log_odds"))
