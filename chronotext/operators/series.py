"""Ranking, first-per-key, calendars and series."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bound


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first in the order.  Equal rows of the order are interchangeable."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_per_group(df: DataFrame, keys, order, k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def ranged(df: DataFrame, value: str, pieces: int = 32) -> Column:
    """The number of the range, of ``pieces`` squared ranges of about as many rows, that a value falls into.

    The limits are approximate quantiles, found by a job of its own; any limits give the same results, only the balance
    differs.  Values that aren't numbers, days or times are all in one range."""
    if not isinstance(df.schema[value].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(0)
    n = pieces * pieces
    shares = F.split(F.lit(";".join(str(i / n) for i in range(1, n))), ";").cast("array<double>")
    limits = df.agg(F.percentile_approx(value, shares, 10 * n)).first()[0]
    if not limits:
        return F.lit(0)
    kind = df.schema[value].dataType.simpleString()
    literal = lambda some: F.array_sort(F.split(F.lit(";".join(map(str, some))), ";").cast(f"array<{kind}>"))
    below = lambda some: F.size(F.filter(some, lambda x: x < F.col(value)))
    limits = sorted(limits)
    return bound(below(literal(limits[pieces - 1 :: pieces])), lambda c: c * pieces + below(F.slice(literal(limits), c * pieces + 1, pieces - 1)))


def by_keys(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Left rows with the other columns of one row per key; null keys meet.  Without keys, the right table has one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"{k}__" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"{k}__"))
    return left.join(renamed, condition, "left").drop(*[f"{k}__" for k in keys])


def running(df: DataFrame, keys, value: str, how, amount: str, out: str, descending: bool = False) -> DataFrame:
    """``how`` (sum or min) of ``amount`` from a key's first value to each; values are distinct and ``__part`` rises with them.

    Windows run inside a part; what earlier parts hold comes from one row per key and part."""
    keys = list(keys)
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    parts = df.groupBy(*keys, "__part").agg(how(amount).alias("__a"))
    earlier = Window.partitionBy(*keys).orderBy(order("__part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "__part", how("__a").over(earlier).alias("__earlier"))
    inside = Window.partitionBy(*keys, "__part").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    here = df.withColumn("__here", how(amount).over(inside))
    whole = F.least if how is F.min else (lambda a, b: F.coalesce(b, F.lit(0)) + a)
    return by_keys(here, parts, [*keys, "__part"]).withColumn(out, whole(F.col("__here"), F.col("__earlier"))).drop("__here", "__earlier")


def percentile_rank(df: DataFrame, value: str, out: str = "pct_rank", by=()) -> DataFrame:
    """Average rank of ties over the number of values; null for null.

    Ranks come from counts of distinct values: rows are counted by value first, running counts go over distinct values.
    Without ``by``, distinct values are dealt to ranges (``ranged``), so that no window runs over all of them.
    """
    by = list(by)
    keys = [f"__k{i}" for i in range(len(by))]
    counts = df.where(F.col(value).isNotNull()).groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    counts = counts.withColumn("__part", F.lit(0) if by else ranged(counts, "__v"))
    summed = by_keys(running(counts, keys, "__v", F.sum, "__c", "__r"), counts.groupBy(*keys).agg(F.sum("__c").alias("__m")), keys)
    ranks = summed.select(*keys, "__v", ((F.col("__r") - F.col("__c") + (F.col("__c") + 1) / 2) / F.col("__m")).alias("__out"))
    condition = F.col(value) == F.col("__v")
    for b, k in zip(by, keys):
        condition = condition & F.col(b).eqNullSafe(F.col(k))
    return df.join(ranks, condition, "left").withColumn(out, F.col("__out")).drop("__v", "__out", *keys)


def monthly_calendar(df: DataFrame, month: str, by=()) -> DataFrame:
    """Every month from a group's first to its last."""
    span = df.groupBy(*by).agg(F.min(month).alias("__a"), F.max(month).alias("__b"))
    return span.select(*by, F.explode(F.sequence("__a", "__b", F.expr("interval 1 month"))).alias(month))


def forward_fill(df: DataFrame, month: str, values, by=()) -> DataFrame:
    """The series on its full calendar, gaps filled with the last value."""
    full = monthly_calendar(df, month, by).join(df, [*by, month], "left")
    w = Window.partitionBy(*by).orderBy(month).rowsBetween(Window.unboundedPreceding, 0)
    return full.select(*by, month, *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values])


def interpolate(df: DataFrame, month: str, value: str, by=()) -> DataFrame:
    """Linear between neighbours by place in the calendar; ends take the nearest value."""
    full = monthly_calendar(df, month, by).join(df.select(*by, month, value), [*by, month], "left")
    w = Window.partitionBy(*by).orderBy(month)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col("__i"), F.col(value).alias("v")))
    full = full.withColumn("__i", F.row_number().over(w)).withColumns({"__a": F.last(point, ignorenulls=True).over(back), "__b": F.first(point, ignorenulls=True).over(ahead)})
    a, b = F.col("__a"), F.col("__b")
    line = a["v"] + (b["v"] - a["v"]) * (F.col("__i") - a["__i"]) / (b["__i"] - a["__i"])
    filled = F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).when(a["__i"] == b["__i"], a["v"]).otherwise(line)
    return full.select(*by, month, filled.alias(value))


def change(df: DataFrame, period: str, value: str, by=()) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(period)
    return df.withColumn("change", F.col(value) - F.lag(value).over(w))


def around(df: DataFrame, period: str, value: str, back: int = 6, forward: int = 2, by=()) -> DataFrame:
    """Means of the ``back`` periods before and of the ``forward`` periods from each one on."""
    w = Window.partitionBy(*by).orderBy(period)
    return df.withColumns({"mean_before": F.avg(value).over(w.rowsBetween(-back, -1)), "mean_from": F.avg(value).over(w.rowsBetween(0, forward - 1))})


def gaps(df: DataFrame, time: str, longer_than_days: int, by=()) -> DataFrame:
    """Silences: neighbouring days further apart than that."""
    days = df.select(*by, F.to_date(time).alias("gap_start")).distinct()
    nxt = days.withColumn("gap_end", F.lead("gap_start").over(Window.partitionBy(*by).orderBy("gap_start")))
    return nxt.withColumn("gap_days", F.datediff("gap_end", "gap_start")).where(F.col("gap_days") > longer_than_days)
