"""Record linkage by normal and fuzzy keys.

Fuzzy scores are 0 to 100, from the longest common subsequence: 100 * 2 * L / (m + n).  Fuzzy pairs come from
``fuzzy.similar_titles``, which finds all of them without a shared word.  Containment is found by character strings.
"""
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import compact_title, normal_title, relaxed_title
from .fuzzy import lcs, similar_titles
from .series import first_per_key


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join([both, *sorted(z)]).strip() if both else " ".join(sorted(z)) for z in (x - y, y - x))
    if both and (not x - y or not y - x):
        return 100.0
    return max(ratio(both, left), ratio(both, right), ratio(left, right)) if both else ratio(left, right)


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text against any stretch of its size."""
    if len(a) > len(b):
        a, b = b, a
    return max((ratio(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1)), default=0.0) if a else 0.0


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_set(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else partial(x, y) for x, y in zip(a, b)], dtype="float64")


def best_match(left: DataFrame, right: DataFrame, left_title: str, right_title: str, weight: str, threshold: float = 88.0, extra: Column | None = None) -> DataFrame:
    """Each left row's best right row by token-set ratio, the heavier one on a tie, then the greater normal title.

    ``extra``, an expression over the structs ``l`` and ``r``, is added to the score when the best is chosen.  Without it
    the heaviest right row of a normal title stands for all of them."""
    x, y = left.withColumn("__l", normal_title(F.col(left_title))), right.withColumn("__r", normal_title(F.col(right_title)))
    pairs = similar_titles(x, y, "__l", "__r", threshold)
    heaviness = F.struct(F.col(weight).isNotNull(), weight, F.xxhash64(*right.columns))
    row = F.struct(*[right[c] for c in right.columns])
    if extra is None:
        held = y.where(F.col("__r") != "").groupBy("__r").agg(F.max_by(row, heaviness).alias("r"))
        order = F.struct("score", F.col(f"r.{weight}"), "b")
        best = pairs.join(held, F.col("b") == F.col("__r")).groupBy("a").agg(F.max_by(F.struct("r", "score"), order).alias("__best"))
        return x.join(best, F.col("__l") == F.col("a")).select(*[x[c] for c in left.columns], F.col("__best.r").alias("match"), F.col("__best.score").alias("score"))
    full = x.select(F.struct(*left.columns).alias("l"), "__l").join(pairs, F.col("__l") == F.col("a")).join(y.select(row.alias("r"), "__r"), F.col("b") == F.col("__r"))
    full = full.select("l", "r", F.col("a").alias("l_title"), F.col("b").alias("r_title"), "score").withColumn("total", F.col("score") + extra)
    best = full.groupBy("l").agg(F.max_by(F.struct("r", "score"), F.struct("total", F.col(f"r.{weight}"), F.col("r_title"))).alias("b"))
    return best.select("l.*", F.col("b.r").alias("match"), F.col("b.score").alias("score"))


def contained(left: DataFrame, right: DataFrame, left_title: str, right_title: str, longer_than: int = 5) -> DataFrame:
    """Pairs with equal normal titles, or one (both of more than ``longer_than`` characters) inside the other.

    All strings of ``longer_than`` + 1 characters of a title are also in a title that contains it, so each title looks
    up its rarest one among those of the other side; no shared word is needed."""
    size = longer_than + 1

    def titled(df, title, name):
        return df.select(F.struct(*df.columns).alias(name), normal_title(F.col(title)).alias(f"{name}_title")).where(f"{name}_title <> ''")

    def grams(df, name):
        title = F.col(f"{name}_title")
        cut = F.transform(F.sequence(F.lit(1), F.length(title) - longer_than), lambda i: F.substring(title, i, F.lit(size)))
        return df.where(F.length(title) >= size).withColumn("gram", F.explode(F.array_distinct(cut)))

    def inside(short, long, name, other):
        held = grams(long, other)
        frequency = held.groupBy("gram").agg(F.count("*").alias("f"))
        rarest = grams(short.select(f"{name}_title").distinct(), name).join(frequency, "gram").groupBy(f"{name}_title").agg(F.min_by("gram", F.struct("f", "gram")).alias("gram"))
        met = rarest.join(held, "gram").where(F.contains(f"{other}_title", F.col(f"{name}_title"))).drop("gram")
        return met.join(short, f"{name}_title").select("l", "r", "l_title", "r_title")

    a, b = titled(left, left_title, "l"), titled(right, right_title, "r")
    equal = a.join(b, F.col("l_title") == F.col("r_title")).select("l", "r", "l_title", "r_title")
    return equal.unionAll(inside(a, b, "l", "r")).unionAll(inside(b, a, "r", "l")).dropDuplicates(["l", "r"])


def hit_score(wanted: Column, found: Column, wanted_artist: Column, found_artist: Column) -> Column:
    """100 for equal titles, 80 or 40 for containment, and up to 30 more for the artist."""
    title = F.when(wanted == found, 100).when(F.contains(found, wanted), 80).when(F.contains(wanted, found), 40).otherwise(0)
    artist = F.when(wanted_artist == found_artist, 30).when(F.contains(found_artist, wanted_artist), 20).when(F.contains(wanted_artist, found_artist), 15).otherwise(0)
    return F.when(title > 0, title + F.coalesce(artist, F.lit(0))).otherwise(0)


def overlap_score(a: Column, b: Column) -> Column:
    return F.when(F.arrays_overlap(a, b), 50 + 5 * F.size(F.array_intersect(a, b))).otherwise(0)


def best_hit(hits: DataFrame, keys, score: str, order, least: float = 60.0) -> DataFrame:
    """The highest score of a key, from ``least`` on; the first in the order on a tie."""
    return first_per_key(hits.where(F.col(score) >= least), keys, [F.desc(score), *order])


def constrained_match(left: DataFrame, right: DataFrame, title: str, year: str, artist: str, weight: str, least: float = 85.0, years: int = 2, artist_least: float = 55.0) -> DataFrame:
    """``best_match`` among rows at most ``years`` apart (a missing year fits all) whose artists reach ``artist_least``.

    Both tables have the columns named.  The artist counts a ten-thousandth in the total; a left row without one passes,
    and counts 0.  Titles are scored once each, and rows of one title, year and artist are matched once: on the right
    the heaviest of them stands for all."""
    keys = [title, year, artist]
    heaviest = F.max_by(F.struct(*right.columns), F.struct(F.col(weight).isNotNull(), weight, F.xxhash64(*right.columns)))
    asked = left.select(*[F.col(k).alias(f"l{i}") for i, k in enumerate(keys)]).distinct()
    held = right.groupBy(*[F.col(k).alias(f"r{i}") for i, k in enumerate(keys)]).agg(heaviest.alias("match"))
    x, y = asked.select("l0").distinct().withColumn("a", normal_title(F.col("l0"))), held.select("r0").distinct().withColumn("b", normal_title(F.col("r0")))
    pairs = x.join(similar_titles(x, y, "a", "b", least), "a").join(y, "b").select("l0", "r0", F.col("b").alias("r_title"), "score")
    close = F.coalesce(F.abs(F.col("l1") - F.col("r1")) <= years, F.lit(True))
    met = asked.join(pairs, "l0").join(held, "r0").where(close)
    wanted, found = normal_title(F.col("l2")), normal_title(F.col("r2"))
    artists = met.select("l2", "r2").distinct().select(F.col("l2").alias("a"), F.col("r2").alias("b"), F.when(F.coalesce(wanted, F.lit("")) == "", 0.0).otherwise(
        F.coalesce(F.greatest(token_set_ratio(wanted, found), partial_ratio(wanted, found)), F.lit(0.0))).alias("likeness"), (F.coalesce(wanted, F.lit("")) == "").alias("nameless"))
    alike = artists.where(F.col("nameless") | (F.col("likeness") >= artist_least))
    met = met.join(alike, F.col("l2").eqNullSafe(F.col("a")) & F.col("r2").eqNullSafe(F.col("b")))
    best = met.groupBy("l0", "l1", "l2").agg(F.max_by(F.struct("match", "score"), F.struct(F.col("score") + 0.0001 * F.col("likeness"), F.col(f"match.{weight}"), F.col("r_title"), F.col("r1"), F.col("r2"))).alias("b"))
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & left[k].eqNullSafe(best[f"l{i}"])
    return left.join(best, condition).select(*[left[c] for c in left.columns], F.col("b.match").alias("match"), F.col("b.score").alias("score"))


def title_variants(title: Column) -> Column:
    """A title as it is, without a last dot, and without brackets and a tail of guests."""
    plain = F.regexp_replace(F.trim(title), r"\.+$", "")
    return F.array_distinct(F.array(F.trim(title), relaxed_title(title), plain, relaxed_title(plain)))


def best_quote(titles: DataFrame, quotes: DataFrame, title: str, quote: str, least: float = 82.0, variants: Column | None = None) -> DataFrame:
    """Each title's best quotation (the smallest on a tie) and its score, from ``least`` on.

    ``variants``, an array such as ``title_variants`` gives, names the wordings that are tried for a title.

    98 if a title of at most 7 letters and digits is the quotation, or (from 4 on) its beginning; 95 if one of at least
    8 lies in the quotation or the other way round; else the token-set ratio."""
    said = quotes.select(F.col(quote).alias("quote")).where(normal_title(F.col(quote)) != "").distinct()
    wordings = F.array(F.col(title)) if variants is None else variants
    asked = titles.select(F.col(title).alias("title"), F.explode(wordings).alias("said")).where(normal_title(F.col("said")) != "").distinct()
    x, y = asked.withColumn("a", normal_title(F.col("said"))), said.withColumn("b", normal_title(F.col("quote")))
    near = x.join(similar_titles(x, y, "a", "b", least), "a").join(y, "b").select("title", "quote", "score")
    small, big = asked.withColumn("c", compact_title(F.col("said"))), said.withColumn("c", compact_title(F.col("quote")))
    held = contained(small.where("length(c) >= 8"), big.where("length(c) >= 8"), "c", "c", longer_than=7).select("l.title", "r.quote", F.lit(95.0).alias("score"))
    starts = big.select("quote", F.explode(F.array_distinct(F.concat(F.array("c"), F.transform(F.sequence(F.lit(4), F.lit(7)), lambda k: F.left("c", k))))).alias("c"))
    begun = small.where("length(c) <= 7").join(starts, "c").select("title", "quote", F.lit(98.0).alias("score"))
    every = near.unionAll(held).unionAll(begun).where(F.col("score") >= least)
    top = every.groupBy("title").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("quote").alias("quote"))).alias("b"))
    return top.select("title", F.col("b.quote").alias("quote"), (-F.col("b.s")).alias("score"))


def lookup_chain(df: DataFrame, lookups) -> DataFrame:
    """The value of the first lookup that has one, as ``found``.

    A lookup is (table, left key, right key, value), or with a guard as a fifth: a condition over the left columns and
    ``value``, without which its value doesn't count."""
    out, names = df, []
    for i, (table, left, right, value, *guard) in enumerate(lookups):
        one = table.where(F.col(right).isNotNull()).groupBy(F.col(right).alias(f"__k{i}")).agg(F.min(value).alias("value"))
        name = f"__v{i}"
        out = out.join(one, F.col(left) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        out = out.withColumn(name, F.when(guard[0], F.col("value")) if guard else F.col("value")).drop("value")
        names.append(name)
    return out.withColumn("found", F.coalesce(*names)).drop(*names)
