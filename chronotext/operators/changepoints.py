"""Change points of series: exact penalised segmentation, consensus and suppression.  A series is one group."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def l2_cost(x):
    s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    return lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)


def rbf_cost(x):
    distance = (x[:, None] - x[None, :]) ** 2
    middle = np.median(distance[np.triu_indices(len(x), 1)]) if len(x) > 1 else 1.0
    kernel = np.exp(-np.clip(distance / (middle or 1.0), 1e-2, 1e2))
    total = np.zeros((len(x) + 1, len(x) + 1))
    total[1:, 1:] = kernel.cumsum(axis=0).cumsum(axis=1)
    trace = np.concatenate([[0], np.cumsum(np.diag(kernel))])
    return lambda a, b: trace[b] - trace[a] - (total[b, b] - total[a, b] - total[b, a] + total[a, a]) / (b - a)


COSTS = {"l2": l2_cost, "rbf": rbf_cost}


def pelt(x, penalty: float, model: str = "l2", least: int = 2) -> list[int]:
    """First places of the new regimes in the cheapest segmentation, pruned as optimal ends allow."""
    x = np.asarray(x, dtype=float)
    if np.isnan(x).all() or len(x) < 2 * least:
        return []
    x = np.where(np.isnan(x), np.nanmedian(x), x)
    cost, n = COSTS[model](x), len(x)
    best, last, live = {0: -penalty}, {}, [0]
    for end in range(least, n + 1):
        tries = [(best[s] + cost(s, end) + penalty, s) for s in live if end - s >= least]
        if not tries:
            continue
        best[end], last[end] = min(tries)
        live = [s for s in live if end - s < least or best[s] + cost(s, end) <= best[end]]
        if n - end >= least:
            live.append(end)
    out, at = [], n
    while at in last and last[at]:
        at = last[at]
        out.append(at)
    return out[::-1]


def nothing(columns: int) -> pd.DataFrame:
    return pd.DataFrame({i: pd.Series(dtype=object) for i in range(columns)})


def detect(series: DataFrame, keys, period: str, value: str, settings) -> DataFrame:
    """Change points of each series and setting (model, penalty): the period, means of both sides, their difference."""
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(p)).alias("penalty")) for m, p in settings])).alias("__s")
    rows = series.select(*keys, F.col(period).alias("period"), F.col(value).cast("double").alias("value"), grid).select(*keys, "period", "value", "__s.model", "__s.penalty")

    def one(key, group):
        group = group.sort_values("period")
        x = group["value"].to_numpy()
        places = [0, *pelt(x, key[-1], key[-2]), len(x)]
        out = []
        for a, b, c in zip(places, places[1:], places[2:]):
            before, after = np.nanmean(x[a:b]), np.nanmean(x[b:c])
            out.append((*key, group["period"].iloc[b], float(before), float(after), float(after - before)))
        return pd.DataFrame(out, columns=range(len(key) + 4)) if out else nothing(len(key) + 4)

    kinds = "".join(f"`{k}` {series.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.groupBy(*keys, "model", "penalty").applyInPandas(one, f"{kinds}model string, penalty double, period date, mean_before double, mean_after double, magnitude double")


def consensus_clusters(days, settings, within: int = 60, least: int = 3):
    """Greedy, by day: a day that no cluster holds yet makes one of all points within reach on either side, others'
    among them, if they have enough settings."""
    days, used, out = np.asarray(days), set(), []
    for day in np.unique(days).tolist():
        if day in used:
            continue
        members = np.flatnonzero(np.abs(days - day) <= within).tolist()
        if len({settings[j] for j in members}) >= least:
            used.update(days[members].tolist())
            out.append(members)
    return out


def consensus(points: DataFrame, keys, within: int = 60, least: int = 3) -> DataFrame:
    """Clusters of change points: median day, support (distinct settings) and median magnitude.  Points of one series
    are few: one per setting and break."""
    def one(key, group):
        group = group.sort_values(["period", "model", "penalty"]).reset_index(drop=True)
        days = (pd.to_datetime(group["period"]) - pd.Timestamp("1970-01-01")).dt.days.to_numpy()
        names = list(zip(group["model"], group["penalty"]))
        out = []
        for members in consensus_clusters(days, names, within, least):
            day = int(np.floor(np.median(days[members])))
            out.append((*key, (pd.Timestamp("1970-01-01") + pd.Timedelta(days=day)).date(), len({names[j] for j in members}), float(np.median(group["magnitude"].to_numpy()[members]))))
        return pd.DataFrame(out, columns=range(len(key) + 3)) if out else nothing(len(key) + 3)

    kinds = "".join(f"`{k}` {points.schema[k].dataType.simpleString()}, " for k in keys)
    return points.groupBy(*keys).applyInPandas(one, f"{kinds}day date, support int, magnitude double")


def suppress(points: DataFrame, keys, within: int = 90) -> DataFrame:
    """Best first by support and size: points within reach of a kept one go."""
    def one(group):
        group = group.assign(__m=group["magnitude"].abs()).sort_values(["support", "__m", "day"], ascending=[False, False, True]).drop(columns="__m")
        days = pd.to_datetime(group["day"])
        kept = []
        for i, d in zip(group.index, days):
            if all(abs((d - days[j]).days) > within for j in kept):
                kept.append(i)
        return group.loc[kept]
    return points.groupBy(*keys).applyInPandas(one, points.schema)


def classify_by_severity(days_severe, days_any, within: int = 90):
    """near_severe, else near_any, else distant: the days to the nearest severe event, and to any."""
    return F.when(F.abs(days_severe) <= within, "near_severe").when(F.abs(days_any) <= within, "near_any").otherwise("distant")


def classify_by_distance(days, near: int = 90, loose: int = 180):
    """confirms_event, near_miss or hidden_inflection: the days to the nearest event (none: hidden)."""
    return F.when(F.abs(days) <= near, "confirms_event").when(F.abs(days) <= loose, "near_miss").otherwise("hidden_inflection")


def at_threshold(clusters: DataFrame, first: int = 6, looser: int = 5, tighter: int = 7, least: int = 5, most: int = 25, wanted: int = 8, last: int = 4) -> DataFrame:
    """Rows (with ``support``) at an adaptive threshold: ``first``; ``looser`` if that leaves fewer than ``least``, ``tighter``
    if more than ``most``; and ``last`` if fewer than ``wanted`` are left and it has more.  One pass counts all of them."""
    n = clusters.agg(*[F.count_if(F.col("support") >= t).alias(str(t)) for t in sorted({first, looser, tighter, last})]).first().asDict()
    chosen = looser if n[str(first)] < least else tighter if n[str(first)] > most else first
    if n[str(chosen)] < wanted and n[str(last)] > n[str(chosen)]:
        chosen = last
    return clusters.where(F.col("support") >= chosen).withColumn("threshold", F.lit(chosen))


def expected_break(points: DataFrame, keys, center: str, upward: bool, within: int = 62) -> DataFrame:
    """Per series the break of the greatest support within ``within`` days of a day and in the direction; the earliest on
    a tie."""
    hit = points.where((F.abs(F.datediff("day", F.lit(center).cast("date"))) <= within) & ((F.col("magnitude") >= 0) == F.lit(upward)))
    return hit.groupBy(*keys).agg(F.max_by(F.struct("day", "magnitude", "support"), F.struct("support", -F.unix_date("day"))).alias("b")).select(*keys, "b.*")


def dominance(df: DataFrame, label: str, year: str, share: str, least: float = 0.8) -> DataFrame:
    """Per label its peak year and share, the first and the last year with at least ``least`` of the peak, and the first of
    July of the middle year."""
    peak = df.groupBy(label).agg(F.max(share).alias("peak_share"), F.max_by(year, F.struct(F.col(share), -F.col(year))).alias("peak_year"))
    strong = df.join(peak, label).where(F.col(share) >= least * F.col("peak_share"))
    out = strong.groupBy(label, "peak_year", "peak_share").agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    return out.withColumn("middle", F.make_date(F.floor((F.col("first_year") + F.col("last_year")) / 2).cast("int"), F.lit(7), F.lit(1)))


def top_months(monthly: DataFrame, month: str, value: str, releases: DataFrame, release_day: str, title: str, events: DataFrame, event_day: str, k: int = 5, listed: int = 15, hidden_after: int = 180) -> DataFrame:
    """The k months of the greatest value with their releases (up to ``listed``, then an ellipsis), the days to the nearest
    event and whether that is too far to explain them."""
    from .temporal import nearest
    top = monthly.where(F.col(value).isNotNull()).orderBy(F.desc(value), month).limit(k)
    titles = releases.join(F.broadcast(top.select(month)), F.trunc(release_day, "MM") == F.col(month)).groupBy(month).agg(F.array_sort(F.collect_set(title)).alias("__t"))
    names = F.concat(F.array_join(F.slice("__t", 1, listed), "; "), F.when(F.size("__t") > listed, "...").otherwise(""))
    near = nearest(top.select(month, value), events.select(F.col(event_day).cast("date").alias("__day"), F.col(event_day).cast("date").alias("__e")), month, "__day", ["__e"]).select(month, value, F.abs("days_away").alias("days_to_nearest"))
    return near.join(titles, month, "left").select(month, value, F.coalesce(names, F.lit("")).alias("released"), "days_to_nearest", F.coalesce(F.col("days_to_nearest") > hidden_after, F.lit(True)).alias("hidden"))
