"""Evidence selection: quality filters, and diverse best rows per category."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quality_filter(words: Column, text: Column, least_words: int = 5, least_distinct: int = 4, least_chars: int = 15, least_ratio: float = 0.0) -> Column:
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return (n >= least_words) & (distinct >= least_distinct) & (F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")) >= least_chars) & (distinct >= least_ratio * n)


def diverse(df: DataFrame, scores: dict, text_key: Column, order, cap: int) -> DataFrame:
    """Each row goes to the category where it stands highest against that category's maximum; of equal texts the best
    row stays; each category keeps its best ``cap`` rows.  Adds ``category``, ``standing`` and ``rank``."""
    tops = df.agg(*[F.max(c).alias(f"__top_{k}") for k, c in scores.items()])
    standing = [F.struct(F.coalesce(F.try_divide(c, F.col(f"__top_{k}")), F.lit(0.0)).alias("standing"), F.lit(k).alias("category")) for k, c in scores.items()]
    best = F.array_max(F.array(*standing))
    rows = df.crossJoin(F.broadcast(tops)).withColumn("__b", best).select(*df.columns, "__b.category", "__b.standing", text_key.alias("__key"))
    first = Window.partitionBy("__key").orderBy(F.desc("standing"), *order)
    once = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__key")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("standing"), *order))).where(F.col("rank") <= cap)


def growing_cap(df: DataFrame, wanted: int, start: int = 5, step: int = 3, last: int = 40) -> DataFrame:
    """Ranked rows up to the smallest cap that gives enough of them: one count per rank decides."""
    counts = [0] * (last + 2)
    for r in df.where(F.col("rank") <= last).groupBy("rank").count().collect():
        counts[r["rank"]] = r["count"]
    cap = start
    while cap < last and sum(counts[: cap + 1]) < wanted:
        cap = min(cap + step, last)
    return df.where(F.col("rank") <= cap)
