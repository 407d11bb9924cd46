"""Joins of facts with a calendar of events.

Time is cut into buckets (months unless told otherwise): inside a bucket a window looks back, and what earlier buckets
hold comes from one row per bucket.  So no window runs over all rows, even where there is no key to deal by.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(facts: DataFrame, events: DataFrame, fact_time: str, event_time: str, payload, by=(), unit: str = "MONTH", forward: bool = False) -> DataFrame:
    """Each fact with the payload of the last event at or before it (``forward``: the first at or after it).

    Adds ``payload`` columns and ``event_at``; null if there is none.  Among events of one time the greatest payload
    (backward) or the smallest (forward) is taken.  Facts without a time get nulls.
    """
    by = list(by)
    kind = facts.schema[fact_time].dataType
    event = F.struct(F.col(event_time).cast(kind).alias("event_at"), *[F.col(p).alias(f"__p{i}") for i, p in enumerate(payload)])
    keyed = events.where(F.col(event_time).isNotNull()).select(*[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)], event.alias("__event"))
    keys = [f"__b{i}" for i in range(len(by))]
    pick = F.min if forward else F.max
    keyed = keyed.groupBy(*keys, F.col("__event.event_at").alias("__t")).agg(pick("__event").alias("__event"))
    keyed = keyed.withColumn("__bucket", F.date_trunc(unit, "__t"))
    left = facts.select(F.struct(*[F.col(c) for c in facts.columns]).alias("__fact"), *[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(fact_time).alias("__t"))
    left = left.withColumn("__bucket", F.date_trunc(unit, "__t"))
    both = left.unionByName(keyed, allowMissingColumns=True)
    side = F.col("__fact").isNotNull()
    order = [F.col("__t").desc() if forward else F.col("__t").asc(), side.asc()]
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__here", F.last("__event", ignorenulls=True).over(inside)).where(side)
    # One row a bucket that holds events, and the bucket where it stops to count: the next such bucket's.
    edges = keyed.groupBy(*keys, "__bucket").agg((F.min if forward else F.max)("__event").alias("__edge"))
    buckets = left.select(*keys, "__bucket").where(F.col("__bucket").isNotNull()).distinct().unionByName(edges, allowMissingColumns=True)
    buckets = buckets.groupBy(*keys, "__bucket").agg(F.max("__edge").alias("__edge"))
    along = Window.partitionBy(*keys).orderBy(F.col("__bucket").desc() if forward else F.col("__bucket").asc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*keys, "__bucket", F.last("__edge", ignorenulls=True).over(along).alias("__before"))
    joined = seen.join(carried, [*keys, "__bucket"], "left") if not keys else seen.alias("s").join(carried.alias("c"), [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "__bucket"]], "left").select("s.*", "c.__before")
    found = F.coalesce("__here", "__before")
    dated = F.col("__t").isNotNull()
    return joined.select("__fact.*", *[F.when(dated, found[f"__p{i}"]).alias(p) for i, p in enumerate(payload)], F.when(dated, found["event_at"]).alias("event_at"))


def nearest(facts: DataFrame, events: DataFrame, fact_time: str, event_time: str, payload, by=()) -> DataFrame:
    """The event fewest days away, the earlier one on a tie, and ``days_away`` (positive after the event)."""
    back = asof(facts, events, fact_time, event_time, payload, by)
    back = back.withColumnsRenamed({**{p: f"__back_{p}" for p in payload}, "event_at": "__back_at"})
    both = asof(back, events, fact_time, event_time, payload, by, forward=True)
    since, until = F.datediff(F.col(fact_time), "__back_at"), F.datediff("event_at", F.col(fact_time))
    earlier = until.isNull() | (since <= until)
    return both.select(*facts.columns, *[F.when(earlier, F.col(f"__back_{p}")).otherwise(F.col(p)).alias(p) for p in payload],
                       F.when(earlier, F.col("__back_at")).otherwise(F.col("event_at")).alias("event_at"), F.when(earlier, since).otherwise(-until).alias("days_away"))


def daily_counts(events: DataFrame, event_time: str, conditions: dict) -> DataFrame:
    """One row a day of the calendar from the first to the last event, with running counts of each condition's events."""
    day = F.to_date(F.col(event_time))
    per_day = events.where(F.col(event_time).isNotNull()).groupBy(day.alias("day")).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
    running = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    span = per_day.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return span.join(per_day, "day", "left").select("day", *[F.sum(F.coalesce(F.col(n), F.lit(0))).over(running).alias(n) for n in conditions])


def trailing_counts(facts: DataFrame, events: DataFrame, fact_time: str, event_time: str, windows, conditions: dict | None = None) -> DataFrame:
    """Events in ``(t - w, t]`` days for each window, as ``<condition>_<w>d``.

    Counts are differences of running daily counts: each window is an equal join on a calendar, whatever the number of
    events.
    """
    conditions = conditions or {"events": F.lit(True)}
    running = daily_counts(events, event_time, conditions)  # one row a day of the calendar
    span = running.agg(F.min("day").alias("__first"), F.max("day").alias("__last"))
    out = facts.crossJoin(F.broadcast(span))

    def at(frame, day, tag):
        named = running.select(F.col("day").alias(f"__day_{tag}"), *[F.col(n).alias(f"__{tag}_{n}") for n in conditions])
        return frame.withColumn(f"__at_{tag}", F.least(day, F.col("__last"))).join(named, F.col(f"__at_{tag}") == F.col(f"__day_{tag}"), "left")

    day = F.to_date(F.col(fact_time))
    out = at(out, day, "now")
    for w in windows:
        out = at(out, F.date_sub(day, w), f"w{w}")
    value = lambda tag, n: F.coalesce(F.col(f"__{tag}_{n}"), F.lit(0))
    return out.select(*facts.columns, *[(value("now", n) - value(f"w{w}", n)).alias(f"{n}_{w}d") for n in conditions for w in windows])


def months_after(events: DataFrame, event_time: str, days: int = 365) -> DataFrame:
    """Every month that ``[event's month, event's month + days]`` touches, one row each, as ``month``."""
    start = F.trunc(F.col(event_time), "MM")
    return events.withColumn("month", F.explode(F.sequence(start, F.trunc(F.date_add(start, days), "MM"), F.expr("interval 1 month"))))


def within_spans(facts: DataFrame, spans: DataFrame, fact_time: str, start: str, end: str, name: str) -> DataFrame:
    """Each fact with the alphabetically first span that holds it.  ``spans`` is a small table of periods: its days are
    listed and joined by equality."""
    days = spans.where(F.col(start) <= F.col(end)).select(F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("__day"), F.col(name)).groupBy("__day").agg(F.min(name).alias(name))
    return facts.join(days, F.to_date(F.col(fact_time)) == F.col("__day"), "left").drop("__day")


def before_after(rows: DataFrame, time: str, pivot: Column, days: int, value: str, by=()) -> DataFrame:
    """Means and counts in ``[pivot - days, pivot)`` and ``(pivot, pivot + days]``."""
    gap = F.datediff(F.to_date(F.col(time)), pivot)
    before, after = gap.between(-days, -1), gap.between(1, days)
    return rows.groupBy(*by).agg(F.avg(F.when(before, F.col(value))).alias("mean_before"), F.avg(F.when(after, F.col(value))).alias("mean_after"), F.count_if(before).alias("n_before"), F.count_if(after).alias("n_after"))
