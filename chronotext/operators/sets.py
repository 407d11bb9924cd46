"""Set operations, upserts, patches and diffs."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def aligned_union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def missing(expected: DataFrame, present: DataFrame, keys) -> DataFrame:
    return expected.join(present, list(keys), "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_common"))


def upsert(table: DataFrame, changes: DataFrame, keys) -> DataFrame:
    return table.join(changes, list(keys), "left_anti").unionByName(changes, allowMissingColumns=True)


def patch(table: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """``patches`` (key, column, value): cells are set, or cleared where the value is null."""
    columns = [r[0] for r in patches.select("column").distinct().collect()]
    wide = patches.groupBy(F.col(key).alias("__k")).agg(*[F.first(F.when(F.col("column") == c, F.struct(F.col("value").alias("v"))), ignorenulls=True).alias(f"__p_{c}") for c in columns])
    out = table.join(wide, F.col(key) == F.col("__k"), "left")
    return out.select(*[F.when(F.col(f"__p_{c}").isNotNull(), F.col(f"__p_{c}.v").cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def without_any(df: DataFrame, exclusions) -> DataFrame:
    """Rows that match none of several key sets (frame, keys)."""
    for other, keys in exclusions:
        df = df.join(other.select(*keys).distinct(), list(keys), "left_anti")
    return df


def grid(a: DataFrame, b: DataFrame, results: DataFrame, keys, status: str = "status", sentinel: str = "not_found") -> DataFrame:
    """Every pair of two small tables with its result, or a sentinel."""
    return a.crossJoin(b).join(results, list(keys), "left").withColumn(status, F.coalesce(F.col(status), F.lit(sentinel)))


def numbered(df: DataFrame, out: str = "place") -> DataFrame:
    """Rows with their place from 0 in the order of the table's partitions and rows, from the partitions' counts: no
    window goes over all rows.  The table is written once, so that both passes see the same order."""
    held = cut(df).withColumn("__id", F.monotonically_increasing_id())
    held = held.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND((1 << 33) - 1)})
    counts = held.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.join(F.broadcast(counts.select("__part", before.alias("__before"))), "__part").select(*df.columns, (F.col("__before") + F.col("__at")).alias(out))


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows side by side by their place in both tables; tables of unequal length are refused."""
    a, b = numbered(left, "__place"), numbered(right, "__place")
    if (n := a.count()) != (m := b.count()):
        raise ValueError(f"{n} rows against {m}")
    return a.join(b, "__place").drop("__place")
