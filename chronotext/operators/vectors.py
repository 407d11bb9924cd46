"""Vectors: cosine similarity to anchors, group centroids, trajectories."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(eps))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector of each group, by positions: sums combine before the shuffle."""
    parts = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("anchor"))


def similarities(df: DataFrame, anchors: DataFrame, vector: str, name: str) -> DataFrame:
    """Rows by anchors (a configuration table of some dozens) with their cosine."""
    listed = F.broadcast(anchors.agg(F.collect_list(F.struct(F.col(name).alias("name"), F.col("anchor").alias("anchor"))).alias("__anchors")))
    scored = F.explode(F.transform("__anchors", lambda a: F.struct(a["name"].alias(name), cosine(F.col(vector), a["anchor"]).alias("similarity")))).alias("__s")
    return df.crossJoin(listed).select(*df.columns, scored).select(*df.columns, F.col(f"__s.{name}").alias(f"anchor_{name}"), "__s.similarity")
