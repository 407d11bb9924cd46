"""Cases worked by hand for rules whose SQL would only repeat them."""
import datetime as dt

from pyspark.sql import functions as F

from chronotext.functions import lexical, scalars, text
from chronotext.operators import changepoints, curation, records, statistics, vocabulary


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_durations(spark):
    cases = {"3 : 41 (album version)": 221, "3:42": 222, "3 minutes and 42 seconds": 222, "[1] 4:05": 245, "minutes": None, "3 minutes": None, "(3:41)": None, "75:10": None, "1:75": None}
    assert {k: value(spark, scalars.duration_seconds(F.lit(k))) for k in cases} == cases


def test_p_texts(spark):
    cases = {0.0: "1e-12", 0.05: "0.05", 0.00012345: "0.0001235", 1.0: "1", 0.123456: "0.1235", 0.00001: "1e-05", float("nan"): "NA"}
    assert {k: value(spark, scalars.p_text(F.lit(k))) for k in cases if k == k} == {k: v for k, v in cases.items() if k == k}
    assert value(spark, scalars.p_text(F.lit(float("nan")))) == "NA"


def test_repaired_encoding(spark):
    good = "MAMA’S café"
    broken = good.encode().decode("latin-1")
    for given, wanted in ((broken, good), ("plain", "plain"), ("Ã alone", "Ã alone"), (broken + " 東京", broken + " 東京"), ("café", "café"), ("", "")):
        assert value(spark, text.repair_encoding(F.lit(given))) == wanted
    assert value(spark, text.repair_encoding(F.lit(None).cast("string"))) is None


def test_pronouns(spark):
    words = ["i'm", "im", "well", "they're", "yall", "he", "you"]
    row = spark.createDataFrame([(words,)], "ws array<string>").select(*lexical.pronoun_counts(F.col("ws"))).first()
    assert tuple(row) == (2, 1, 2, 1)
    assert value(spark, lexical.first_person_share(F.array(F.lit("i"), F.lit("i'd"), F.lit("in"), F.lit("we")))) == 0.5


def test_tiers(spark):
    rows = [(0.01, 0.4, True), (0.01, 0.28, True), (0.01, -0.4, True), (0.05, 0.9, True), (0.01, 0.25, True), (0.01, 0.4, False), (0.01, float("nan"), True), (None, 0.4, True)]
    got = [r[0] for r in spark.createDataFrame(rows, "p double, z double, x boolean").select(statistics.tier(F.col("p"), F.col("z"), F.col("x"))).collect()]
    assert got == ["STRONG", "MODERATE", "STRONG", "NONE", "NONE", "NONE", "NONE", "NONE"]


def test_clusters_look_both_ways():
    # Day 100 sees day 150 as well: three settings.  Day 200 then sees 150, which is used, and has two settings only.
    days, settings = [100, 100, 150, 200, 290], ["a", "b", "c", "a", "a"]
    assert changepoints.consensus_clusters(days, settings, 60, 3) == [[0, 1, 2]]
    assert changepoints.consensus_clusters([0, 50, 100], ["a", "b", "c"], 60, 3) == [[0, 1, 2]]  # seen from day 50


def test_distinctive_terms(spark):
    counts = spark.createDataFrame([("x", "own", 9), ("x", "both", 9), ("y", "both", 1), ("x", "the", 99), ("y", "other", 2)], "g string, term string, n long")
    got = {(r.g, r.term) for r in vocabulary.tfidf(counts, "g", 5, stop_words=("the",)).collect()}
    assert got == {("x", "own"), ("y", "other")}  # a term in two of two groups is above 0.85


def test_targets_in_order(spark):
    rows = spark.createDataFrame([(1, "Song One", "aa  BB"), (2, "Song One", "aa cc"), (3, "Else", "bb")], "id int, t string, x string")
    targets = spark.createDataFrame([(1, "song", "aa"), (2, "one", "bb"), (3, "song", "aa"), (4, "else", "b")], "place int, title string, fragment string")
    got = {r.place: r.id for r in records.targets_in_order(rows, targets, "t", "x", ["id"]).collect()}
    assert got == {1: 1, 3: 2, 4: 3}  # the only text of target 2 was taken by target 1


def test_addresses(spark):
    assert value(spark, text.prefers_direct(F.lit("T"), F.lit("https://x/a"), F.lit("https://x/A/"))) is False
    assert value(spark, text.prefers_direct(F.lit("T"), F.lit("https://x/a"), F.lit("https://x/b"))) is True
    assert value(spark, text.prefers_direct(F.lit("T"), F.lit("https://x/a"), F.lit(None).cast("string"))) is False
    assert value(spark, records.valid_address(F.lit("https://h/music/name?x"), "music", ("browse",))) is True
    assert value(spark, records.valid_address(F.lit("https://h/music"), "music", ("browse",))) is False


def test_themed_pick(spark):
    rows = spark.createDataFrame([("a", f"line {i}", float(i), 0.1 * i) for i in range(6)] + [("b", f"text {i}", 1.0, 0.45) for i in range(3)], "g string, x string, v double, s double")
    got = curation.themed_pick(rows, "g", "x", "v", F.col("s"), [F.col("x") == "line 2"]).collect()
    assert {(r.g, r["rank"], r.x) for r in got if r.g == "a"} == {("a", 1, "line 2"), ("a", 2, "line 5"), ("a", 3, "line 4")} and {r.bound for r in got} == {0.5} and sum(r.g == "b" for r in got) == 3


def test_month_permutation(spark):
    day = dt.date
    monthly = spark.createDataFrame([(day(2020, 1, 1), 10.0, 10), (day(2020, 3, 1), 30.0, 10)], "month date, s double, n long")
    events = spark.createDataFrame([(day(2020, 1, 1),), (day(2020, 1, 1),), (day(2020, 3, 1),), (day(2021, 1, 1),)], "e date")
    got = {r.e: (r.delta, r.p) for r in statistics.month_permutation_p(monthly, events, "month", "s", "n", "e", 1.5, 20).collect()}
    assert got[day(2020, 1, 1)] == (-0.5, 0.75) and got[day(2020, 3, 1)] == (1.5, 0.25) and got[day(2021, 1, 1)] == (None, None)


def test_ranks_in_ranges(spark):
    """Windows cut into ranges give the ranks and adjusted p of one window, with ties, nulls and every distribution."""
    import numpy as np
    from chronotext.operators import series, statistics
    for values in ([], [None, None], [1.0], [2.0, 2.0, None, 1.0], list(np.random.default_rng(1).exponential(size=3000).round(2)), [0.5] * 900 + [float(i) for i in range(100)]):
        df = spark.createDataFrame([(i, v if v is None else float(v)) for i, v in enumerate(values)], "i long, p double")
        got = {r.i: r for r in statistics.benjamini_hochberg_of_many(series.percentile_rank(df.selectExpr("i", "p"), "p"), "p", "many").collect()}
        one = {r.i: r.p_bh for r in statistics.benjamini_hochberg(df, "p").collect()}
        known = np.array([v for v in values if v is not None], dtype=float)
        for i, v in enumerate(values):
            if v is None:
                assert got[i].pct_rank is None and got[i].many is None and one[i] is None
            else:
                assert abs(got[i].pct_rank - ((known < v).sum() + ((known == v).sum() + 1) / 2) / len(known)) < 1e-9 and abs(got[i].many - one[i]) < 1e-9


def test_adjusted_p_of_what_is_no_p(spark):
    import math
    from chronotext.operators import statistics
    df = spark.createDataFrame([(0, 0.01), (1, 0.02), (2, float("nan")), (3, None), (4, 1.5), (5, -0.1), (6, float("inf"))], "i int, p double")
    for f in (statistics.benjamini_hochberg, statistics.benjamini_hochberg_of_many):
        got = {r.i: r.p_bh for r in f(df, "p").collect()}
        assert (got[0], got[1]) == (0.02, 0.02) and math.isnan(got[2]) and got[3] is None and (got[4], got[5], got[6]) == (1.5, -0.1, math.inf)


def test_matches_against_all_pairs(spark):
    from chronotext.operators import linkage
    left = [(1, "Red Moon", 2001, "Ann Lee"), (2, "Red Moon", 2009, "Ann Lee"), (3, "blue sea song", 2004, None), (4, "blue sea song", None, "Zed"), (5, "", 2004, "Ann Lee"), (6, None, 2004, "Ann Lee")]
    right = [(10, "Red Moons", 2002, "Ann Lee", 5), (11, "Red Moon (live)", 2003, "Ann Lee and Bob", 7), (12, "blue sea", 2006, "Other", 1), (13, "blue sea", 2006, "Other", 2), (14, "Red Moon", 2001, "Nobody Else", 9)]
    a, b = spark.createDataFrame(left, "key long, title string, year int, artist string"), spark.createDataFrame(right, "key long, title string, year int, artist string, w long")
    got = {r.key: (r["match"].key, round(r.score, 6)) for r in linkage.constrained_match(a, b, "title", "year", "artist", "w").collect()}
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    want = {}
    for k, t, y, who in left:
        best = None
        for m, u, z, other, w in right:
            x, o, score = norm(who), norm(other), linkage.token_set(norm(t), norm(u))
            like = max(linkage.token_set(x, o), linkage.partial(x, o)) if x else 0.0
            if score >= 85 and (y is None or abs(y - z) <= 2) and (not x or like >= 55):
                best = max(best or (-1,), (score + 0.0001 * like, w, m, round(score, 6)))
        if best:
            want[k] = best[2:]
    assert got == want and got[3][0] == 13
    titles = spark.createDataFrame([("Sunset",), ("Abcdefgh",), ("Gone",), ("two words here",), ("No",), (None,), ("",)], "t string")
    quotes = spark.createDataFrame([("sunsets at sea",), ("xxabcdefghxx",), ("words here two",), ("gon",), ("nothing",), ("no",), (None,)], "q string")
    found = {r.title: (r.quote, r.score) for r in linkage.best_quote(titles, quotes, "t", "q").collect()}
    assert found.pop("Gone")[0] == "gon"
    assert found == {"Sunset": ("sunsets at sea", 98.0), "Abcdefgh": ("xxabcdefghxx", 95.0), "two words here": ("words here two", 100.0), "No": ("no", 100.0)}
    tried = {r.title: r.quote for r in linkage.best_quote(spark.createDataFrame([("Late Night (Remix).",)], "t string"), spark.createDataFrame([("late nihgt",)], "q string"), "t", "q", variants=linkage.title_variants(F.col("t"))).collect()}
    assert tried == {"Late Night (Remix).": "late nihgt"}


def test_npy_and_pages(spark, tmp_path):
    import numpy as np
    from chronotext.functions import text
    from chronotext.sources import markup, readers
    made = np.arange(5000 * 3, dtype="float64").reshape(5000, 3)
    np.save(tmp_path / "v.npy", made)
    rows = readers.npy_vectors(spark, str(tmp_path)).orderBy("n").collect()
    assert [list(r.vector) for r in rows] == made.tolist() and [r.n for r in rows] == list(range(5000))
    layouts = [("div", "data-x", "true", True), ("div", "class", "Box__", False), ("div", "class", "plain", True)]
    pages = [(1, '<div class="a Box__b">one<br>two<div>in</div></div><p>out</p><div class="Box__c">three</div>'), (2, '<div class="plain">x &amp; y</div><div data-x="true">first</div>'), (3, "<p>none"), (4, None)]
    got = {r.page_id: r.text for r in markup.containers(spark.createDataFrame(pages, "page_id long, html string"), layouts).collect()}
    assert got == {1: "one\ntwo\nin\nthree", 2: "first", 3: "", 4: ""}
    line = "This song was released long ago and it " + "goes on " * 8 + "here."
    cases = [(None, ""), ("a\r\nb", "a\nb"), (f"{line}\n\n" * 7 + "end", f"{line}\n\n{line}\n\nend"), (line[:-1], line[:-1]), ("x Read More y", "y"), ("12 Contributors T Lyrics\nla", "la"), ("la12Embed", "la")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", text.clean_page(F.col("t")).alias("c"))
    assert [r.c for r in df.orderBy("i").collect()] == [c[1] for c in cases]
    assert spark.createDataFrame([("ﬁn Ⅳ",), (None,)], "t string").select(text.compatible("t").alias("c")).collect() == [("fin IV",), (None,)]
