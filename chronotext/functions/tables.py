"""Table and aggregate functions for SQL text: ``register(spark)`` makes them known to a session.

* ``text_sections(text)``: the ``[marker: credit] body`` sections of a text, for a lateral join.
* ``change_points(TABLE(t), keys => 'a, b', period => 'p', value => 'v' [, model, penalty])``: change points of each series.
* ``bootstrap_interval(TABLE(t), keys => 'a', value => 'v' [, draws, seed])``: mean of each group with its interval.
* ``trimmed_mean(value, share)``: the mean without the lowest and the highest ``share`` of a group's values.

The two functions of a table name its partitions and order themselves, from ``keys``; their result has these keys, of the
types that the table gives them.  Null keys are a partition of their own; null, NaN and infinite values don't count.  An
empty table gives no rows.  A series is one task's memory, and so is a group of ``trimmed_mean``; the bootstrap holds
two numbers a draw, whatever a group's size.
"""
import re

import numpy as np
import pandas as pd
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, pandas_udf, udtf
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..operators.changepoints import COSTS, pelt

SECTION = re.compile(r"\[([^\]]*)\]([^\[]*)")


@udtf(returnType="place int, marker string, credit string, body string")
class TextSections:
    """A section a row; a text before the first marker is a section without one.  A null text has none."""

    def eval(self, text: str):
        for place, (head, body) in enumerate(SECTION.findall("[]" + text) if text is not None else ()):
            marker, _, credit = head.partition(":")
            yield place, marker, credit.strip(" "), body.strip()


def _text(argument: AnalyzeArgument | None, name: str, default=None):
    if argument is None and default is not None:
        return default
    if argument is None or not argument.isConstantExpression or argument.value is None:
        raise ValueError(f"{name} must be a constant")
    return argument.value


def _columns(table: AnalyzeArgument, keys: str, *others: str):
    """The fields of the keys; a name that the table lacks is refused."""
    if not table.isTable:
        raise ValueError("the first argument must be TABLE(...)")
    names = [k.strip() for k in keys.split(",") if k.strip()]
    missing = [n for n in (*names, *others) if n not in table.dataType.fieldNames()]
    if not names or missing:
        raise ValueError(f"no such column: {', '.join(missing)}" if missing else "keys must name a column")
    return [table.dataType[n] for n in names]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@udtf
class ChangePoints:
    """The periods at which a series changes its level, with the means of both sides."""

    @staticmethod
    def analyze(table: AnalyzeArgument, keys: AnalyzeArgument, period: AnalyzeArgument, value: AnalyzeArgument,
                model: AnalyzeArgument = None, penalty: AnalyzeArgument = None) -> AnalyzeResult:
        at, of = _text(period, "period"), _text(value, "value")
        fields = _columns(table, _text(keys, "keys"), at, of)
        if (kind := _text(model, "model", "l2")) not in COSTS:
            raise ValueError(f"model must be one of {', '.join(COSTS)}, not {kind}")
        _text(penalty, "penalty", 3.0)
        schema = StructType([*fields, StructField("period", table.dataType[at].dataType), StructField("before", DoubleType()), StructField("after", DoubleType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(_quoted(f.name)) for f in fields], orderBy=[OrderingColumn(_quoted(at))])

    def __init__(self):
        self.key, self.periods, self.values, self.setting = None, [], [], None

    def eval(self, table, keys: str, period: str, value: str, model: str = "l2", penalty: float = 3.0):
        if self.key is None:
            self.key, self.setting = tuple(table[k.strip()] for k in keys.split(",") if k.strip()), (model, float(penalty))
        v = table[value]
        if table[period] is not None:
            self.periods.append(table[period])
            self.values.append(float(v) if v is not None and np.isfinite(float(v)) else np.nan)

    def terminate(self):
        x = np.array(self.values)
        ends = pelt(x, self.setting[1], self.setting[0]) if len(x) else []
        for last, at, following in zip([0, *ends], ends, [*ends[1:], len(x)]):
            before, after = (x[a:b][~np.isnan(x[a:b])] for a, b in ((last, at), (at, following)))
            yield (*self.key, self.periods[at], float(before.mean()) if len(before) else None, float(after.mean()) if len(after) else None)


@udtf
class BootstrapInterval:
    """A group's mean and its 95% interval.  A draw takes each row as often as a Poisson number of mean 1 says, so rows go
    by one after the other, in the order of their values, which makes the result that of the rows alone."""

    @staticmethod
    def analyze(table: AnalyzeArgument, keys: AnalyzeArgument, value: AnalyzeArgument, draws: AnalyzeArgument = None, seed: AnalyzeArgument = None) -> AnalyzeResult:
        of = _text(value, "value")
        fields = _columns(table, _text(keys, "keys"), of)
        if not 1 <= _text(draws, "draws", 1000) <= 100_000:
            raise ValueError("draws must be from 1 to 100,000")
        _text(seed, "seed", 1)
        schema = StructType([*fields, StructField("n", LongType()), *(StructField(c, DoubleType()) for c in ("mean", "ci_low", "ci_high"))])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(_quoted(f.name)) for f in fields], orderBy=[OrderingColumn(_quoted(of))])

    BLOCK = 256

    def __init__(self):
        self.key, self.random, self.waiting, self.n, self.total = None, None, [], 0, 0.0

    def eval(self, table, keys: str, value: str, draws: int = 1000, seed: int = 1):
        if self.key is None:
            self.key = tuple(table[k.strip()] for k in keys.split(",") if k.strip())
            self.random, self.sums, self.counts = np.random.default_rng(seed), np.zeros(draws), np.zeros(draws)
        v = table[value]
        if v is not None and np.isfinite(float(v)):
            self.waiting.append(float(v))
            if len(self.waiting) == self.BLOCK:
                self.take()

    def take(self):
        x = np.array(self.waiting)
        times = self.random.poisson(1.0, (len(self.sums), len(x)))
        self.sums += times @ x
        self.counts += times.sum(1)
        self.n, self.total, self.waiting = self.n + len(x), self.total + x.sum(), []

    def terminate(self):
        if self.waiting:
            self.take()
        if not self.n:
            yield (*self.key, 0, None, None, None)
            return
        drawn = self.counts > 0
        low, high = np.percentile(self.sums[drawn] / self.counts[drawn], [2.5, 97.5]) if drawn.any() else (None, None)
        yield (*self.key, self.n, float(self.total / self.n), low if low is None else float(low), high if high is None else float(high))


@pandas_udf(DoubleType())
def trimmed_mean(value: pd.Series, share: pd.Series) -> float:
    """Of n finite values floor(n * share) go at each end; null if none are left."""
    x = np.sort(value.to_numpy(dtype="float64", na_value=np.nan))
    x = x[np.isfinite(x)]
    cut = int(len(x) * float(share.iloc[0]) + 1e-9) if len(x) else 0
    kept = x[cut : len(x) - cut]
    return float(kept.mean()) if len(kept) else None


FUNCTIONS = {"text_sections": TextSections, "change_points": ChangePoints, "bootstrap_interval": BootstrapInterval}


def register(spark) -> None:
    """Makes the functions known to a session, under the names above."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
    spark.udf.register("trimmed_mean", trimmed_mean)
