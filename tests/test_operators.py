"""Hand-made cases: nulls, ties, empty tables and closed forms."""
import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronotext.functions import lexical, scalars, text
from chronotext.operators import aggregates, changepoints, evidence, linkage, series, sets, statistics, temporal, vectors
from chronotext.sources import markup, readers, writers
from chronotext.streaming import windows


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def day(s):
    return dt.date.fromisoformat(s)


def test_syllables(spark):
    words = {"": 0, "the": 1, "table": 2, "make": 1, "rhythm": 1, "a": 1, "whale": 1, "coffee": 1, "''": 0, "little": 2, "i've": 1}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", lexical.syllables(F.col("w")).alias("n"))
    assert {r.w: r.n for r in rows.collect()} == words


def test_text_functions(spark):
    assert value(spark, F.size(text.verses(F.lit("a\n\nb\n \nc")))) == 3
    assert value(spark, text.normal_title(F.lit("Élan, Vital!"))) == "elan vital"
    assert value(spark, text.artists(F.lit("A & B, C feat. A"))) == ["A", "B", "C"]
    assert value(spark, text.artists(F.lit("B10 & C21 feat. D2"))) == ["B10", "C21", "D2"]
    assert value(spark, text.strip_markdown(F.lit("## A [b](c) *d*"))) == "A b d"
    assert value(spark, text.drop_lines(F.lit("a\nb\nc"), [1])) == "a\nc"
    assert value(spark, text.from_marker(F.lit("xx[Intro] y"), "[Intro]")) == "[Intro] y"
    parsed = value(spark, text.sections(F.lit("head\n[Verse 1: A & B]\nx\n[Chorus]\n")))
    assert [(p.marker, p.credit, p.body) for p in parsed] == [("", "", "head"), ("Verse 1", "A & B", "x"), ("Chorus", "", "")]
    assert value(spark, text.matches(F.lit(None).cast("string"), "x")) is False


def test_scalars(spark):
    assert value(spark, scalars.impute_date(F.lit("2004"))) == day("2004-07-01")
    assert value(spark, scalars.impute_date(F.lit("2004-02-03T10:00"))) == day("2004-02-03")
    assert value(spark, scalars.impute_date(F.lit(None).cast("string"), F.lit(day("2001-01-01")))) == day("2001-01-01")
    assert value(spark, scalars.parse_day(F.lit("Sept 30"), F.lit(2007))) == day("2007-09-30")
    assert value(spark, scalars.duration_seconds(F.lit("3:42"))) == 222
    assert value(spark, scalars.duration_seconds(F.lit("3 minutes 42 seconds (album)"))) == 222
    assert value(spark, scalars.score_out_of_100(F.lit("4.5/5"))) == 90.0
    assert value(spark, scalars.append_note(F.lit("a"), F.lit("b"))) == "a; b"
    assert value(spark, scalars.safe_ratio(F.lit(1), F.lit(0))) is None


def test_mtld_and_hdd(spark):
    rows = spark.createDataFrame([(["w"] * 60,), ([f"w{i}" for i in range(60)],), (["a"] * 10,), (None,)], "ws array<string>")
    got = [r[0] for r in rows.select(lexical.mtld(F.col("ws"))).collect()]
    assert got == [2.0, 0.0, 0.0, None]  # no factor at all counts as 0
    hdd = [r[0] for r in rows.select(lexical.hdd("ws")).collect()]
    assert abs(hdd[0] - 1 / 42) < 1e-9 and abs(hdd[1] - 1) < 1e-9 and hdd[2] is None


def test_asof(spark):
    facts = spark.createDataFrame([(1, day("2020-01-10")), (2, day("2020-01-01")), (3, day("2021-05-01")), (4, None)], "id int, d date")
    events = spark.createDataFrame([("b", day("2020-01-10")), ("a", day("2020-01-10")), ("c", day("2020-03-05"))], "name string, at date")
    got = {r.id: (r.name, r.event_at) for r in temporal.asof(facts, events, "d", "at", ["name"]).collect()}
    assert got == {1: ("b", day("2020-01-10")), 2: (None, None), 3: ("c", day("2020-03-05")), 4: (None, None)}
    assert temporal.asof(facts.limit(0), events, "d", "at", ["name"]).count() == 0
    assert {r.name for r in temporal.asof(facts, events.limit(0), "d", "at", ["name"]).collect()} == {None}


def test_trailing_and_nearest(spark):
    facts = spark.createDataFrame([(1, day("2020-01-10"))], "id int, d date")
    events = spark.createDataFrame([("x", day("2020-01-05")), ("y", day("2020-01-10")), ("z", day("2020-01-15"))], "name string, at date")
    assert temporal.trailing_counts(facts, events, "d", "at", [5, 6]).first().asDict() == {"id": 1, "d": day("2020-01-10"), "events_5d": 1, "events_6d": 2}
    near = temporal.nearest(facts, events.where("name <> 'y'"), "d", "at", ["name"]).first()
    assert (near.name, near.days_away) == ("x", 5)


def test_percentile_rank_and_fdr(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0), (4, None)], "id int, v double")
    assert [r.pct_rank for r in series.percentile_rank(df, "v").orderBy("id").collect()] == [0.5, 0.5, 1.0, None]
    p = spark.createDataFrame([(0.0,), (0.01,), (0.04,), (None,), (1.0,), (0.04,)], "p double")
    got = sorted((r.p, r.p_bh) for r in statistics.benjamini_hochberg(p, "p").where("p is not null").collect())
    assert np.allclose([b for _, b in got], [0.0, 0.025, 0.05, 0.05, 1.0])


def test_series(spark):
    df = spark.createDataFrame([(day("2020-01-01"), 1.0), (day("2020-04-01"), 4.0)], "m date, v double")
    assert [r.v for r in series.forward_fill(df, "m", ["v"]).orderBy("m").collect()] == [1, 1, 1, 4]
    assert [r.v for r in series.interpolate(df, "m", "v").orderBy("m").collect()] == [1, 2, 3, 4]
    assert series.forward_fill(df.limit(0), "m", ["v"]).count() == 0


def test_change_points():
    assert changepoints.pelt([1.0] * 30, 3) == []
    assert changepoints.pelt([0.0] * 20 + [5.0] * 20, 3) == [20]
    assert changepoints.pelt([0.0] * 20 + [5.0] * 20 + [0.0] * 20, 3, "rbf") == [20, 40]
    assert changepoints.pelt([float("nan")] * 9, 3) == []


def test_suppression(spark):
    rows = [("k", day("2020-01-01"), 5, 1.0), ("k", day("2020-03-31"), 4, 1.0), ("k", day("2020-07-01"), 3, 1.0)]
    df = spark.createDataFrame(rows, "k string, day date, support int, magnitude double")
    assert sorted(r.day for r in changepoints.suppress(df, ["k"]).collect()) == [day("2020-01-01"), day("2020-07-01")]


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(50)] + [("b", 1.0)], "g string, v double")
    got = {r.g: r for r in statistics.bootstrap_ci(df, ["g"], "v", 500).collect()}
    assert got["a"].ci_low < got["a"].point == 24.5 < got["a"].ci_high and got["b"].ci_low == got["b"].ci_high == 1.0
    assert got["a"].ci_low == {r.g: r for r in statistics.bootstrap_ci(df.repartition(3), ["g"], "v", 500).collect()}["a"].ci_low


@pytest.mark.parametrize(("shard_values", "huge"), [(65_536, 1e6), (500, 1e6), (500, 60.0)])
def test_resampled_p(spark, shard_values, huge):
    """Against draws made row by row; with one huge value no normal curve and no quantiles will do."""
    r = np.random.default_rng(3)
    rows = [("some", float(x)) for x in r.exponential(50, 400)] + [("off", float(x)) for x in r.exponential(57, 300)] + [("few", 90.0)] * 5 + [("rare", 0.0)] * 299 + [("rare", huge)]
    rows += [(None, float(x)) for x in r.exponential(50, 4000)] + [("few", None), ("some", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x.g: x for x in statistics.resampled_p(df, ["g"], "v", shard_values=shard_values).collect()}
    pool = np.array([v for _, v in rows if v is not None and math.isfinite(v)])
    for g in ("some", "off", "few", "rare", None):
        mine = np.array([v for k, v in rows if k == g and v is not None and math.isfinite(v)])
        means = np.array([r.choice(pool, len(mine)).mean() for _ in range(10_000)])
        p = (1 + np.sum(np.abs(means - pool.mean()) >= abs(mine.mean() - pool.mean()))) / 10_001
        assert got[g].n == len(mine) and math.isclose(got[g].mean, mine.mean()) and abs(got[g].p - p) < 0.03, (g, got[g].p, p)
    again = {x.g: x.p for x in statistics.resampled_p(df.repartition(3), ["g"], "v", shard_values=shard_values).collect()}
    assert again == {g: x.p for g, x in got.items()}
    assert statistics.resampled_p(df.limit(0), ["g"], "v", shard_values=shard_values).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_fuzzy(a, b):
    def slow(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                t[i + 1][j + 1] = t[i][j] + 1 if x[i] == y[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]
    assert linkage.lcs(a, b) == slow(a, b)
    assert linkage.ratio(a, a) == 100.0 and math.isclose(linkage.ratio(a, b), linkage.ratio(b, a))


def test_linkage(spark):
    assert linkage.token_set("late night tale", "tale late night live") == 100.0
    left = spark.createDataFrame([("Late Night",), ("Unknown",)], "t string")
    right = spark.createDataFrame([("late night!", 5), ("late night", 9)], "u string, w int")
    assert [(r.t, r.match.w) for r in linkage.best_match(left, right, "t", "u", "w").collect()] == [("Late Night", 9)]


def test_contained_without_shared_words(spark):
    titles = ["sunflower", "sunflowers", "the sunflowerseed", "flower", "flow", "flow", "one", "one two", "abcdef", "xabcdefx", "東京東京東京", "は東京東京東京は", "", None]
    left = spark.createDataFrame(list(enumerate(titles)), "i int, t string")
    right = spark.createDataFrame(list(enumerate(titles)), "j int, u string")
    normal = {r.i: r.n for r in left.select("i", text.normal_title(F.col("t")).alias("n")).collect()}
    expected = {(i, j) for i, a in normal.items() for j, b in normal.items() if a and b and (a == b or len(a) > 5 and len(b) > 5 and (a in b or b in a))}
    got = [(r.l.i, r.r.j) for r in linkage.contained(left, right, "t", "u").collect()]
    assert sorted(got) == sorted(expected) and {(0, 1), (3, 0), (8, 9)} <= expected
    assert linkage.contained(left.limit(0), right, "t", "u").count() == 0


def test_sets(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sorted(map(tuple, sets.upsert(t, spark.createDataFrame([(2, "c"), (3, "d")], t.schema), ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    p = spark.createDataFrame([(1, "v", None), (2, "v", "z")], "id int, column string, value string")
    assert sorted(map(tuple, sets.patch(t, p, "id").collect())) == [(1, None), (2, "z")]
    assert aggregates.null_profile(t).count() == 2


def test_evidence(spark):
    d = spark.createDataFrame([(i, f"text {i % 3}", i) for i in range(9)], "id int, t string, a int")
    out = evidence.diverse(d, {"x": F.col("a"), "y": -F.col("a")}, F.col("t"), ["id"], 5)
    assert out.count() == 3
    assert vectors.cosine is not None


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"x\ny"\n2,\n')
    assert [r.t for r in readers.read_csv_strings(spark, str(tmp_path / "a.csv")).orderBy("id").collect()] == ["x\ny", None]
    (tmp_path / "l.jsonl").write_text('{"k":1,"n":1,"v":"a"}\nbroken\n{"k":1,"n":2,"v":"b"}\n')
    assert [r.v for r in readers.read_checkpoint(spark, str(tmp_path / "l.jsonl"), "k int, n int, v string", ["k"], "n").collect()] == ["b"]
    (tmp_path / "c.md").write_text('## 2004 — *Early*\n- "One" — A, B [Single]\n- "Two"\n## Misattributed\n- "Three"\n')
    rows = markup.catalogue(markup.markdown_lines(spark, str(tmp_path / "c.md")), "misattributed").orderBy("n").collect()
    assert [(r.year, r.era, r.title, r.credit, r.tags) for r in rows] == [(2004, "Early", "One", "A, B", "Single"), (2004, "Early", "Two", None, None)]
    page = "<p>By Jo</p><p>a<br>b</p><table><tr><td rowspan=2>y</td><td>1</td></tr><tr><td>2</td></tr></table><script type='application/ld+json'>{\"reviewBody\":\"long\"}</script>"
    parsed = markup.pages(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string"))
    assert [r.cells for r in markup.table_rows(parsed).orderBy("row").collect()] == [["y", "1"], ["y", "2"]]
    assert markup.longest_review(parsed).first().body == "long"
    assert markup.article_body(parsed.where("page_id = 1")).first().body == "ab"
    assert writers.markdown_table(spark.createDataFrame([("a|b", 1.0)], "x string, y double")).endswith("| a\\|b | 1.0000 |")


def test_stream(spark, tmp_path):
    schema = "ts timestamp, k string"
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), "a") for h in range(5)] + [(dt.datetime(2024, 1, 5), "a")], schema)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", ["k"])
    windows.stream_to(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert [r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [5]




def test_filters(spark):
    from chronotext.functions import filters
    assert value(spark, filters.after_within(F.lit(day("2020-01-01")), F.lit(day("2020-01-01")), 5)) is False
    assert value(spark, filters.before_within(F.lit(day("2020-01-01")), F.lit(day("2020-01-01")), 5)) is True
    assert value(spark, filters.is_metadata(F.lit("Single, Sept 30"))) is True
    assert value(spark, filters.is_metadata(F.lit("Jo Smith"))) is False
    assert value(spark, filters.plausible_address(F.lit("http://x.org/jo-late-night-lyrics"), F.lit("Late Night"))) is True
    assert value(spark, filters.over_floor(F.lit(0.3), F.lit("m"), {"m": 0.5})) is False
    assert value(spark, filters.finite(F.lit(float("nan")))) is False


def test_models(spark):
    from chronotext.operators import models
    df = spark.createDataFrame([(1, "good text"), (2, None), (3, "x")], "id int, t string")
    got = models.score_rows(df, "t", lambda: lambda texts: [(len(t), "ok") for t in texts], "size int, label string", longer_than=1).orderBy("id").collect()
    assert [(r.size, r.label) for r in got] == [(9, "ok"), (None, None), (None, None)]
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "term string, valence double")
    rows = spark.createDataFrame([(1, ["very", "good"]), (2, ["not", "good"]), (3, ["plain"])], "id int, ws array<string>")
    out = {r.id: r.compound for r in models.sentiment(rows, ["id"], F.col("ws"), lexicon).collect()}
    assert out[1] > 0.5 and out[2] < 0 and out[3] == 0
    models.register_functions(spark)
    assert spark.sql("select token_set_ratio('a b', 'b a') as r").first().r == 100.0


def test_records(spark):
    from chronotext.operators import records
    wanted = spark.createDataFrame([("A", "x", 1), ("a ", "X", 2), ("B", "y", 3), ("skip", "y", 4)], "t string, a string, n int")
    done = spark.createDataFrame([("b", "Y")], "t string, a string")
    assert [r.n for r in records.to_acquire(wanted, done, "t", "a", "n", F.col("t") == "skip").collect()] == [1]
    failed = records.parse_failures(spark.createDataFrame([("[timeout] One | A | early",), ("noise",)], "value string"))
    assert tuple(failed.first()) == ("timeout", "One", "A", "early")
    names = spark.createDataFrame([("don", "Don"), ("don two", "Don Two")], "needle string, name string")
    assert records.canonical_name(spark.createDataFrame([("the Don Two deluxe",)], "t string"), "t", names).first().canonical_name == "Don Two"
    assert value(spark, records.pick_address(F.array(F.lit("b/x"), F.lit("a/y"), F.lit("c/z")), ["z", "x"])) == "c/z"
    left = spark.createDataFrame([("Song (live)",), ("Other",)], "t string")
    right = spark.createDataFrame([("Song", "v")], "u string, val string")
    assert {r.t: r.val for r in records.second_attempt(left, right, "t", "u", "val").collect()} == {"Song (live)": "v", "Other": None}
    assert value(spark, records.stable_uid(F.lit(""), F.lit("n"), F.lit(2004))) == "n##2004"
    rows = spark.createDataFrame([(1, "T", "aa bb"), (2, "T", "aa")], "id int, t string, x string")
    targets = spark.createDataFrame([(1, "T", "aa"), (2, "T", "bb")], "place int, title string, fragment string")
    assert [(r.place, r.id) for r in records.targets_in_order(rows, targets, "t", "x", ["id"]).collect()] == [(1, 1)]
    try:
        records.gate(rows, F.col("id") > 0, 1, "too many")
        raise AssertionError
    except ValueError:
        pass
