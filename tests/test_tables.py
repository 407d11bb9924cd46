"""Functions called from SQL text."""
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException

from chronotext.functions import tables, text
from chronotext.operators import changepoints
from pyspark.sql import functions as F


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    tables.register(spark)


def test_sections_equal_the_column_expression(spark):
    texts = ["before [Verse 1: Ada ] one\ntwo [Chorus]\n\n three [Verse: Bo: x]", "", None, "no marker", "[a]x[b: c]"]
    spark.createDataFrame(list(enumerate(texts)), "k long, t string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT k, s.* FROM texts, LATERAL text_sections(t) s ORDER BY k, place").collect()
    parsed = spark.table("texts").select("k", F.posexplode(text.sections(F.col("t"))).alias("place", "s")).select("k", "place", "s.*").sort("k", "place").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in parsed] and {r.k for r in got} == {0, 1, 3, 4}


def test_change_points_equal_the_operator(spark):
    random = np.random.default_rng(3)
    rows = [(k, "x", p, float(random.normal(level, 0.1))) for k in (1, 2, None) for p, level in enumerate([0] * 8 + [5] * 7 + [k or 9] * 6)]
    rows += [(4, "x", 0, None), (4, "x", 1, float("nan")), (2, "x", 30, float("inf")), (5, "y", None, 2.0)]
    spark.createDataFrame(rows, "k long, `o d` string, p int, v double").createOrReplaceTempView("series")
    got = spark.sql("SELECT * FROM change_points(TABLE(series), keys => 'k, o d', period => 'p', value => 'v', penalty => 3)").collect()
    assert got[0].__fields__ == ["k", "o d", "period", "before", "after"]
    found = {k: [r.period for r in sorted(got, key=lambda r: r.period) if r.k == k] for k in (1, 2, 4, 5, None)}
    for k in (1, 2, None):
        x = np.array([v if math.isfinite(v) else np.nan for key, _, p, v in rows if key == k])
        periods = [p for key, _, p, _ in rows if key == k]
        assert found[k] == [periods[i] for i in changepoints.pelt(x, 3.0)] and found[k][0] == 8
    assert found[4] == [] and found[5] == []
    first = next(r for r in got if r.k == 1 and r.period == 8)
    assert abs(first.before) < 0.2 and abs(first.after - 5) < 0.2


@pytest.mark.parametrize("call", ["change_points(TABLE(series), keys => 'k', period => 'none', value => 'v')", "change_points(TABLE(series), keys => 'k', period => 'p', value => 'v', model => 'l9')",
                                  "change_points(TABLE(series), keys => '', period => 'p', value => 'v')", "bootstrap_interval(TABLE(series), keys => 'k', value => 'v', draws => 0)"])
def test_wrong_arguments_are_refused_before_the_job(spark, call):
    spark.createDataFrame([(1, 1, 1.0)], "k long, p int, v double").createOrReplaceTempView("series")
    with pytest.raises(PySparkException):
        spark.sql(f"SELECT * FROM {call}").schema


def test_bootstrap(spark):
    random = np.random.default_rng(5)
    values = random.normal(10, 2, 700)
    rows = [("a", float(v)) for v in values] + [("b", 4.0)] * 3 + [("c", None), ("c", float("nan")), (None, 1.0), ("a", float("inf"))]
    spark.createDataFrame(rows, "k string, v double").repartition(5).createOrReplaceTempView("drawn")
    sql = "SELECT * FROM bootstrap_interval(TABLE({}), keys => 'k', value => 'v', draws => 2000, seed => 4)"
    got = {r.k: r for r in spark.sql(sql.format("drawn")).collect()}
    error = 1.96 * values.std() / math.sqrt(len(values))
    assert got["a"].n == 700 and math.isclose(got["a"].mean, values.mean())
    assert abs(got["a"].ci_low - (values.mean() - error)) < 0.15 * error and abs(got["a"].ci_high - (values.mean() + error)) < 0.15 * error
    assert (got["b"].n, got["b"].mean, got["b"].ci_low, got["b"].ci_high) == (3, 4.0, 4.0, 4.0) and got[None].n == 1
    assert got["c"].n == 0 and got["c"].mean is None
    spark.createDataFrame(rows[::-1], "k string, v double").createOrReplaceTempView("turned")
    assert {r.k: r for r in spark.sql(sql.format("turned")).collect()} == got
    spark.createDataFrame([], "k string, v double").createOrReplaceTempView("empty")
    assert spark.sql(sql.format("empty")).collect() == []


def test_trimmed_mean(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", None), ("c", 5.0), ("a", None)]
    spark.createDataFrame(rows, "k string, v double").createOrReplaceTempView("trimmed")
    got = {r.k: r.m for r in spark.sql("SELECT k, trimmed_mean(v, 0.2) AS m FROM trimmed GROUP BY k").collect()}
    assert got == {"a": 3.0, "b": None, "c": 5.0}
