"""Greedy grouping in a stated order.  It is not transitive: a row joins the first group whose *first* member it matches,
else it opens a group.  Groups are named by their first member.

* ``first_groups`` is for rules of equal keys and a value that is equal or free to match: rows of one key and value
  share all their matches, so a key's groups follow from one row a value, without a pair.
* ``greedy_groups`` takes any pairs.  Rounds decide all rows whose earlier partners are decided: those without an
  undecided earlier partner open groups, their later partners join, and the pairs of both go.  In an order that has
  nothing to do with the pairs the rounds grow with the logarithm of the rows; a chain in which each row waits for the
  one before takes a round for two of its rows, until ``finish`` pairs are left, which one task goes through.
"""
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_title
from .fuzzy import BLOCK, similar_titles
from .lineage import cut

FINISH = 200_000


def first_groups(df: DataFrame, keys, order: str, value: Column, free: Column, out: str = "group_id") -> DataFrame:
    """Each row with the ``order`` of its group's first member.

    Rows match if their ``keys`` are equal and either their values are or one of them is ``free``.  ``order`` numbers the
    rows.  Nulls equal nulls, and a null ``free`` is false.  A free row that comes first takes all rows of its keys; any
    other free row joins the first row's group, so that each value opens one group at most."""
    keys = list(keys)
    free = F.coalesce(free, F.lit(False))
    rows = df.withColumns({"__free": free, "__value": F.when(~free, value)})
    classes = rows.groupBy(*keys, "__free", "__value").agg(F.min(order).alias("__first"))
    heads = classes.groupBy(*keys).agg(F.min(F.struct("__first", "__free")).alias("__head"))
    named = _equal(classes, heads, keys).withColumn(out, F.when(F.col("__head.__free") | F.col("__free"), F.col("__head.__first")).otherwise(F.col("__first")))
    return _equal(rows, named.drop("__head", "__first"), [*keys, "__free", "__value"]).select(*df.columns, out)


def _equal(left, right, names):
    """An inner join in which nulls equal nulls, with the names once."""
    other = right.select(*[F.col(n).alias(f"__o{i}") for i, n in enumerate(names)], *[c for c in right.columns if c not in names])
    condition = F.lit(True)
    for i, n in enumerate(names):
        condition = condition & F.col(n).eqNullSafe(F.col(f"__o{i}"))
    return left.join(other, condition).drop(*[f"__o{i}" for i in range(len(names))])


def _rest(pairs: pd.DataFrame) -> pd.DataFrame:
    """The rows that join, of pairs (a before b), one row after the other."""
    joined = set()
    for a, b in pairs.sort_values(["b", "a"])[["a", "b"]].itertuples(index=False):
        if a not in joined:
            joined.add(b)
    return pd.DataFrame({"node": np.array(sorted(joined), dtype=pairs["b"].dtype)})


def greedy_groups(nodes: DataFrame, pairs: DataFrame, finish: int = FINISH) -> DataFrame:
    """(node, group_id) of every distinct number of ``nodes``; smaller numbers come first.

    ``pairs`` (a, b) are all that match, in either direction; repeated ones, a node with itself, nulls and numbers that
    aren't in ``nodes`` have no effect."""
    every = cut(nodes.select(F.col(nodes.columns[0]).alias("node")).where("node is not null").distinct())
    held = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    held = held.join(every.withColumnRenamed("node", "a"), "a", "left_semi").join(every.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
    edges = left = cut(held)
    joined = []
    while (n := left.count()) > finish:
        ends = left.select(F.col("a").alias("node"), F.lit(0).alias("later")).unionAll(left.select("b", F.lit(1)))
        opened = cut(ends.groupBy("node").agg(F.max("later").alias("later")).where("later = 0").select("node"))
        joins = cut(left.join(opened.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct())
        joined.append(joins)
        decided = opened.unionAll(joins)
        left = cut(left.join(decided.withColumnRenamed("node", "a"), "a", "left_anti").join(joins.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"))
    if n:
        kind = edges.schema["b"].dataType.simpleString()
        joined.append(left.groupBy().applyInPandas(_rest, f"node {kind}"))
    if not joined:
        return every.withColumn("group_id", F.col("node"))
    members = joined[0]
    for more in joined[1:]:
        members = members.unionAll(more)
    members = cut(members)
    first = edges.join(members.withColumnRenamed("node", "a"), "a", "left_anti").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("group_id"))
    return every.join(first, "node", "left").select("node", F.coalesce("group_id", "node").alias("group_id"))


def title_groups(df: DataFrame, key: str, title: str, least: float = 88.0, finish: int = FINISH, block: int = BLOCK, out: str = "group_id") -> DataFrame:
    """Each row with the smallest ``key`` of its group, whose first title it resembles by a token-set ratio of ``least``.

    Rows of equal normal titles are one node, so copies are never paired.  A row without a title is its own group."""
    rows = df.withColumn("__title", F.coalesce(normal_title(F.col(title)), F.lit("")))
    firsts = cut(rows.where("__title <> ''").groupBy("__title").agg(F.min(key).alias("node")))
    met = similar_titles(firsts, firsts, "__title", "__title", least, block, once=True).where("a <> b").select("a", "b")
    number = lambda side: firsts.select(F.col("__title").alias(side), F.col("node").alias(f"n{side}"))
    pairs = met.join(number("a"), "a").join(number("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    groups = firsts.join(greedy_groups(firsts.select("node"), pairs, finish), "node").select("__title", F.col("group_id").alias(out))
    return rows.join(groups, "__title", "left").select(*df.columns, F.coalesce(out, key).alias(out))
