"""Upkeep of record tables: recovery sets, failure logs, overrides, address picks, grids of sources, tiers, audits."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dedup_key, normal_title, relaxed_title, squeeze
from .series import ranged


def to_acquire(wanted: DataFrame, done: DataFrame, title: str, artist: str, ordinal: str, skip: Column, limit: int | None = None) -> DataFrame:
    """What is left to fetch: without skipped rows, once per key (the first), and without what a checkpoint holds."""
    keyed = wanted.where(~F.coalesce(skip, F.lit(False))).withColumn("__key", dedup_key(F.col(title), F.col(artist)))
    first = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy(ordinal))).where("__n = 1")
    left = first.join(done.select(dedup_key(F.col(title), F.col(artist)).alias("__key")).distinct(), "__key", "left_anti").drop("__n", "__key")
    return left.orderBy(ordinal).limit(limit) if limit is not None else left


def parse_failures(lines: DataFrame, line: str = "value") -> DataFrame:
    """``[reason] title | artist | era`` lines."""
    part = lambda i: F.nullif(F.trim(F.regexp_extract(line, r"^\[([^\]]*)\]\s*([^|]*)(?:\|([^|]*))?(?:\|(.*))?$", i)), F.lit(""))
    return lines.where(F.col(line).rlike(r"^\[")).select(part(1).alias("reason"), part(2).alias("title"), part(3).alias("artist"), part(4).alias("era"))


def still_failing(failures: DataFrame, recovered: DataFrame, keys=("title",)) -> DataFrame:
    return failures.join(recovered.select(*keys).distinct(), list(keys), "left_anti")


def recovery_set(listed: DataFrame, found: DataFrame, existing: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(listed and found) less existing less known."""
    return listed.select(key).union(found.select(key)).distinct().join(existing.select(key), key, "left_anti").join(known.select(key), key, "left_anti")


def second_attempt(left: DataFrame, right: DataFrame, title: str, right_title: str, value: str) -> DataFrame:
    """A value by the title, else by the title without brackets and guests."""
    table = right.groupBy(F.col(right_title).alias("__t")).agg(F.min(value).alias("__v"))
    one = left.join(table, F.col(title) == F.col("__t"), "left").withColumnRenamed("__v", "__v1").drop("__t")
    two = one.withColumn("__r", relaxed_title(F.col(title))).join(table, F.col("__r") == F.col("__t"), "left")
    return two.withColumn(value, F.coalesce("__v1", "__v")).drop("__v1", "__v", "__t", "__r")


def routed(targets: DataFrame, overrides: DataFrame, key: str, url: str, detail: str) -> DataFrame:
    """An override's address, else one in the free text of a detail, else the own one; and what was done."""
    out = targets.join(overrides.select(key, F.col("url").alias("__o")), key, "left")
    in_detail = F.nullif(F.regexp_extract(detail, r"(https?://\S+)", 1), F.lit(""))
    chosen = F.coalesce("__o", in_detail, url)
    status = F.when(F.col("__o").isNotNull(), "override").when(in_detail.isNotNull(), "from_detail").when(F.col(url).isNotNull(), "own").otherwise("none")
    return out.withColumns({"chosen_url": chosen, "status": status}).drop("__o")


def pick_address(urls: Column, needles) -> Column:
    """Of sorted distinct addresses the first with the earliest needle; else the first."""
    ordered = F.array_sort(F.array_distinct(urls))
    return F.coalesce(*[F.try_element_at(F.filter(ordered, _has(n)), F.lit(1)) for n in needles], F.try_element_at(ordered, F.lit(1)))


def _has(needle):
    return lambda u: F.contains(u, F.lit(needle))


def best_peak(rows: DataFrame, uid: str, peak: str, extras=()) -> DataFrame:
    """The smallest peak per uid with its other columns, and whether peaks disagree."""
    others = [F.min_by(F.col(c), F.struct(F.col(peak), F.col(c))).alias(c) for c in extras]
    return rows.where(F.col(peak).isNotNull()).groupBy(uid).agg(F.min(peak).alias(peak), *others, (F.count_distinct(peak) > 1).alias("conflicting"))


def canonical_name(df: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """The name whose needle (the longest first) a text holds.  ``names`` (needle, name) is a small table."""
    listed = [(r[0], r[1]) for r in names.select("needle", "name").collect()]
    out = F.lit(None).cast("string")
    for needle, name in sorted(listed, key=lambda x: (len(x[0]), x[0])):
        out = F.when(F.contains(F.lower(F.col(text)), F.lit(needle.lower())), name).otherwise(out)
    return df.withColumn("canonical_name", out)


def last_write(rows: DataFrame, keys: Column, value: str, ordinal: str) -> DataFrame:
    """A lookup by each of a row's keys; of one key the last row's value."""
    return rows.select(F.explode(keys).alias("key"), value, ordinal).groupBy("key").agg(F.max_by(value, F.struct(ordinal, value)).alias(value))


def reapplied(rows: DataFrame, column: str, cleaner) -> DataFrame:
    """The column cleaned again, and how many rows that changes."""
    new = cleaner(F.col(column))
    return rows.agg(F.count_if(~new.eqNullSafe(F.col(column))).alias("n_changed"), F.count("*").alias("n_rows"))


def metric_grid(df: DataFrame, key: str, metrics) -> DataFrame:
    """Rows by metric: (key, metric, value)."""
    return df.unpivot([key], list(metrics), "metric", "value")


def audit(expected: DataFrame, present: DataFrame, group: str, key: str) -> DataFrame:
    """Found of total by group, and a grade."""
    marked = expected.select(group, key).distinct().join(present.select(key).distinct().withColumn("__here", F.lit(1)), key, "left")
    out = marked.groupBy(group).agg(F.count("*").alias("total"), F.count("__here").alias("found"))
    return out.withColumn("grade", F.when(F.col("found") == F.col("total"), "complete").when(F.col("found") >= 0.8 * F.col("total"), "nearly").otherwise("gaps"))


def gate(df: DataFrame, condition: Column, at_most: int, message: str) -> DataFrame:
    """Stops if too many rows meet a condition."""
    n = df.where(condition).limit(at_most + 1).count()
    if n > at_most:
        raise ValueError(f"{message}: more than {at_most} rows")
    return df


def in_month(points: DataFrame, months: DataFrame, day: str, month: str, keys=()) -> DataFrame:
    """Which (keys, month) rows have a point in them, as ``has_point``."""
    hit = points.select(*keys, F.trunc(day, "MM").alias(month)).distinct().withColumn("__hit", F.lit(True))
    return months.join(hit, [*keys, month], "left").withColumn("has_point", F.coalesce("__hit", F.lit(False))).drop("__hit")


def targets_in_order(rows: DataFrame, targets: DataFrame, title: str, text: str, order, most: int = 1000) -> DataFrame:
    """For each (place, title, fragment) target, in the order of places, the first row whose title and text contain both
    (case and spaces don't matter) and whose title and text no earlier target took.

    n targets can take n - 1 texts before one, so the first n different texts of each are enough; they are the only rows
    that meet in one task.  ``targets`` is a short list: more than ``most`` are refused."""
    n = targets.count()
    if n > most:
        raise ValueError(f"more than {most} targets")
    norm = F.lower(squeeze(F.col(text)))
    small = F.broadcast(targets.select("place", F.lower("title").alias("__title"), F.lower(squeeze(F.col("fragment"))).alias("__fragment")))
    hits = rows.withColumn("__norm", norm).join(small, F.contains(F.lower(title), F.col("__title")) & F.contains(F.col("__norm"), F.col("__fragment")))
    once = hits.withColumn("__n", F.row_number().over(Window.partitionBy("place", title, "__norm").orderBy(*order))).where("__n = 1")
    few = once.withColumn("__n", F.row_number().over(Window.partitionBy("place").orderBy(*order))).where(F.col("__n") <= n)

    def take(group):
        used, kept = set(), []
        for _, options in group.sort_values(["place", "__n"]).groupby("place"):
            for i, row in options.iterrows():
                if (key := (row[title], row["__norm"])) not in used:
                    used.add(key)
                    kept.append(i)
                    break
        return group.loc[kept].drop(columns=["__title", "__fragment", "__norm", "__n"])

    return few.groupBy().applyInPandas(take, few.drop("__title", "__fragment", "__norm", "__n").schema)


def replacement(rows: DataFrame, used: DataFrame, title: str, text: str, value: str, least_words: int = 6) -> DataFrame:
    """The row of the greatest value whose title and text are not among used ones and that has enough words."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z0-9']+)"))
    fresh = rows.join(used.select(title).distinct(), title, "left_anti").withColumn("__k", F.lower(squeeze(F.col(text))))
    fresh = fresh.join(used.select(F.lower(squeeze(F.col(text))).alias("__k")).distinct(), "__k", "left_anti").where(F.size(words) >= least_words)
    return fresh.drop("__k").orderBy(F.desc(value), title, text).limit(1)


def candidate_pool(first: DataFrame, others: DataFrame, text: str) -> DataFrame:
    """Rows of two sources, one for each text (case and spaces don't matter), the first source's before the other's."""
    both = first.withColumn("source_rank", F.lit(0)).unionByName(others.withColumn("source_rank", F.lit(1)), allowMissingColumns=True)
    key = F.lower(squeeze(F.col(text)))
    order = Window.partitionBy(key).orderBy("source_rank", *[F.col(c) for c in sorted(set(both.columns) - {"source_rank"})])
    return both.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def enriched(items: DataFrame, catalogue: DataFrame, title: str) -> DataFrame:
    """Which items a catalogue lacks by normal title: ``in_catalogue``, and a recommended action by ``credible`` (a boolean)."""
    known = catalogue.select(normal_title(F.col(title)).alias("__t")).distinct().withColumn("__h", F.lit(True))
    out = items.withColumn("__t", normal_title(F.col(title))).join(known, "__t", "left").withColumn("in_catalogue", F.coalesce("__h", F.lit(False)))
    action = F.when(F.col("in_catalogue") | F.coalesce("credible", F.lit(False)), "keep").when(~F.col("credible"), "exclude").otherwise("review")
    return out.withColumn("action", action).drop("__t", "__h")


def misses(scored: DataFrame, score: str, threshold: float, order) -> DataFrame:
    """What a matcher left below its threshold, the nearest misses first.

    Rows are ranked inside ranges of the score, and one row a range carries the counts on, so no window goes over all."""
    below = scored.where(F.coalesce(F.col(score) < threshold, F.lit(True)))
    placed = below.withColumn("__part", F.when(F.col(score).isNull(), 1).otherwise(-ranged(below, score)))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(F.desc_nulls_last(score), *order))
    ranked = placed.withColumn("__n", inside).join(counts.select("__part", before.alias("__before")), "__part")
    return ranked.select(*scored.columns, (F.col("__n") + F.col("__before")).cast("int").alias("miss_rank"))


def reflagged(rows: DataFrame, flags: DataFrame, key: str, template: str = "flagged: %s") -> DataFrame:
    """Rows with a note made from the reason of their flag (``flags``: key, reason); the others keep theirs."""
    reasons = flags.groupBy(key).agg(F.min("reason").alias("__r"))
    return rows.join(reasons, key, "left").withColumn("note", F.when(F.col("__r").isNotNull(), F.format_string(template, "__r")).otherwise(F.col("note"))).drop("__r")


def renamed(col: Column, exact: dict, prefixes=()) -> Column:
    """Names by a map; else without the first prefix that they begin with."""
    out = col
    for prefix in reversed(list(prefixes)):
        out = F.when(F.startswith(col, F.lit(prefix)), F.substr(col, F.lit(len(prefix) + 1))).otherwise(out)
    for name, put in exact.items():
        out = F.when(col == name, put).otherwise(out)
    return out


def valid_address(url: Column, first: str, not_second=(), least_parts: int = 2) -> Column:
    """Whether an address's path begins with a part, goes on, and not with one of some parts."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), r"[?#].*$", ""), "/"), lambda p: p != "")
    return F.coalesce((F.size(parts) >= least_parts) & (F.get(parts, F.lit(0)) == first) & ~F.get(parts, F.lit(1)).isin(*not_second or [""]), F.lit(False))


def preferred_address(df: DataFrame, keys, url: str, needle: str) -> DataFrame:
    """Per key the address that holds a needle, the shortest, then the smallest."""
    lacks = ~F.contains(F.lower(url), F.lit(needle.lower()))
    return df.where(F.col(url).isNotNull()).groupBy(*keys).agg(F.min_by(F.col(url), F.struct(lacks, F.length(url), F.col(url))).alias(url))


def stable_uid(slug: Column, norm: Column, year: Column) -> Column:
    return F.coalesce(F.nullif(slug, F.lit("")), F.concat_ws("##", norm, year.cast("string")))
