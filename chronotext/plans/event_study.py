"""Facts against a calendar of events: proximity, tests and breaks."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changepoints, series, statistics, temporal


def proximity(facts: DataFrame, events: DataFrame, fact_time: str, event_time: str, label: str, windows=(90, 180, 365, 730)) -> DataFrame:
    """Each fact with the last event before it, the days since, and the events in trailing windows.

    Facts are dealt by the hour, so a task's window holds an hour's facts and the one over buckets a row an hour."""
    counted = temporal.trailing_counts(facts, events, fact_time, event_time, windows)
    last = temporal.asof(counted, events, fact_time, event_time, [label], unit="HOUR")
    return last.withColumn("days_since", F.datediff(F.col(fact_time), "event_at"))


def tested(facts: DataFrame, keys, value: str, draws: int = 10_000) -> DataFrame:
    """Mean, interval, effect size, adjusted p and tier of each group."""
    effect = statistics.effect_sizes(facts, keys, value)
    ci = statistics.bootstrap_ci(facts, keys, value, draws).drop("n")
    p = statistics.resampled_p(facts, keys, value, draws).select(*keys, "p")
    joined = effect.join(ci, keys).join(p, keys)
    whole = facts.agg(F.avg(value)).first()[0]
    excluded = statistics.excludes(F.col("ci_low"), F.col("ci_high"), whole if whole is not None else float("nan"))
    flagged = statistics.benjamini_hochberg(joined, "p").withColumn("excludes_baseline", excluded)
    return flagged.withColumns({"substantive": statistics.substantive(F.col("excludes_baseline"), F.col("z")), "tier": statistics.tier(F.col("p_bh"), F.col("z"), F.col("excludes_baseline"))})


def breaks(facts: DataFrame, keys, day: str, value: str, settings=tuple((m, p) for m in ("l2", "rbf") for p in (3, 5, 8, 10))) -> DataFrame:
    """Change points of monthly means that several settings agree on, without close neighbours."""
    monthly = facts.groupBy(*keys, F.trunc(day, "MM").alias("period")).agg(F.avg(value).alias("value"))
    filled = series.forward_fill(monthly, "period", ["value"], keys)
    points = changepoints.detect(filled, keys, "period", "value", settings)
    return changepoints.suppress(changepoints.consensus(points, keys), keys)
