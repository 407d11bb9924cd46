"""Rollups and profiles."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, keys, value: str, positive: float = 0.05, negative: float = -0.05) -> DataFrame:
    """Count, mean, median, sample deviation (0 for one row), extremes and shares above, below and between bounds."""
    v = F.col(value)
    share = lambda c: F.avg(F.when(v.isNotNull(), c.cast("int")))
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
                                 share(v > positive).alias("pct_above"), share(v < negative).alias("pct_below"), share(v.between(negative, positive)).alias("pct_between"))


def rollups(df: DataFrame, groupings, measures) -> DataFrame:
    """The same measures by several keys in one pass: ``grouping`` names the key, ``key`` its value."""
    keys = F.explode(F.array(*[F.struct(F.lit(name).alias("grouping"), F.col(name).cast("string").alias("key")) for name in groupings])).alias("__g")
    return df.select("*", keys).groupBy("__g.grouping", "__g.key").agg(*measures)


def shares(df: DataFrame, keys, within) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: nulls (NaN and empty strings among them), and rows."""
    def missing(c, kind):
        col = F.col(f"`{c}`")
        return col.isNull() | (F.isnan(col) if kind in ("double", "float") else col == "" if kind == "string" else F.lit(False))
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(missing(c, k)).alias(f"__c{i}") for i, (c, k) in enumerate(df.dtypes)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__c{i}").alias("n_missing"), F.col("__n").alias("n_rows")) for i, (c, _) in enumerate(df.dtypes)])).alias("r")).select("r.*")


def ordered_text(df: DataFrame, keys, order: str, text: str, separator: str = " ") -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda p: p["t"])
    return df.groupBy(*keys).agg(F.array_join(parts, separator).alias("joined"))


def collisions(df: DataFrame, key: str, group: str, least: int = 2) -> DataFrame:
    """Keys that stand in several groups, with the groups' names."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(group)), "; ").alias("groups"), F.count_distinct(group).alias("n_groups")).where(F.col("n_groups") >= least)


def argmax(df: DataFrame, keys, label: str, value: str) -> DataFrame:
    """Label of the greatest and of the smallest value; the smaller label on a tie."""
    return df.groupBy(*keys).agg(F.max(value).alias("peak"), F.min(value).alias("trough"), F.min_by(F.col(label), F.struct(-F.col(value), F.col(label))).alias("peak_label"), F.min_by(F.col(label), F.struct(F.col(value), F.col(label))).alias("trough_label"))
