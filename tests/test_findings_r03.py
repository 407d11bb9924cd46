"""Cases of the findings of the third round."""
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronotext import queries
from chronotext.functions import lexical
from chronotext.operators import density, embeddings, entities, fuzzy, linear, models, statistics, tagging
from chronotext.plans import event_study


@pytest.mark.parametrize("types", [("LARGE", "PROMO"), ("PROMO", "LARGE")])
def test_curated_parts_with_equal_sizes_of_two_types(spark, tmp_path, types):
    """of equal rows in two buckets the one of the smallest key counts, as in SQL."""
    duckdb.sql(f"""copy (select r as p_partkey, 'n' || (r // 2) as p_name, 'b' || (r % 4 // 2) as p_brand, case when (r + r // 2) % 2 = 0 then '{types[0]}' else '{types[1]}' end as p_type, 9::int as p_size
from range(40) t(r)) to '{tmp_path}/part.parquet'""")
    want = duckdb.sql(queries.ORACLE_SQL["curated_parts"].replace("FROM part", f"FROM '{tmp_path}/part.parquet'")).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in queries.QUERIES["curated_parts"](spark, str(tmp_path)).collect())


def shuffled(spark, run):
    """Rows that the stages of a call write to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}
    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def test_words_meet_in_one_shuffle(spark, tmp_path):
    """pairs of words are counted once and not shuffled in four plans."""
    rows = spark.range(60).select("id", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(150)))).alias("ws")).cache()
    pairs = rows.select(F.explode(F.arrays_zip(F.slice("ws", 1, 199).alias("a"), F.slice("ws", 2, 199).alias("b"))).alias("p")).distinct().count()
    told = []
    n = shuffled(spark, lambda: told.extend(embeddings.pair_information(rows, F.col("ws"), 1).groupBy("a").count().collect()))
    assert len(told) == 150 and n < 6 * pairs


def test_places_of_words_are_not_shuffled(spark):
    """a block's texts and its distinct phrases are shuffled, not each place where a phrase may start."""
    rows = spark.range(50).select("id", F.array_repeat(F.lit("a"), 400).alias("ws")).cache()
    gazetteer = spark.createDataFrame([("a", "TERM"), ("a a a", "PLACE")] + [(f"a x{k}", "TERM") for k in range(2000)], "phrase string, label string").cache()
    told = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        n = shuffled(spark, lambda: told.extend(entities.entities(rows, "id", F.col("ws"), gazetteer).select("n_entities").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r[0] for r in told] == [134] * 50 and n < 10_000


@pytest.mark.parametrize("finish", [0, 30, 10_000])
def test_spanning_forest_finishes_in_one_task(spark, finish):
    """few edges take no rounds of jobs, and give the same forest as the rounds."""
    edges = spark.range(300).select(F.xxhash64(F.pmod(F.xxhash64("id"), F.lit(90))).alias("lo"), F.xxhash64(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(90))).alias("hi"), (F.col("id") % 7 / 10).alias("w")).where("lo < hi").distinct()
    tree, labels = density.spanning_forest(edges, finish)
    parent = {}

    def root(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    want = []
    for w, lo, hi in sorted((r.w, r.lo, r.hi) for r in edges.collect()):
        if root(lo) != root(hi):
            parent[root(lo)] = root(hi)
            want.append((lo, hi, w))
    assert sorted(want) == sorted(tuple(r) for r in tree.collect())
    groups = {}
    for r in labels.collect():
        groups.setdefault(r.root, set()).add(root(r.node))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({root(n) for n in parent})


def test_products_of_the_matrix_shuffle_no_pairs(spark):
    """the pairs are shuffled when they are counted, not in each product."""
    rows = spark.range(60).select("id", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(150)))).alias("ws")).cache()
    pairs = rows.select(F.explode(F.arrays_zip(F.slice("ws", 1, 199).alias("a"), F.slice("ws", 2, 199).alias("b"))).alias("p")).distinct().count()
    told = []
    n = shuffled(spark, lambda: told.extend(embeddings.word_vectors(rows, F.col("ws"), 4, 1, 6)[0].collect()))
    assert len(told) == 150 and n < 3 * pairs


@pytest.mark.parametrize("common", [0, 3, 25])
def test_rarer_words_have_the_vectors_that_frequent_ones_would(spark, monkeypatch, common):
    """which words are broadcast changes nothing."""
    texts = [(i, [f"w{(i * k * k + k) % 40}" for k in range(i % 9 + 1)] + [None]) for i in range(70)] + [(90, None), (91, ["alone"])]
    df = spark.createDataFrame(texts, "id long, ws array<string>")

    def run():
        vectors, sigma = embeddings.word_vectors(df, F.col("ws"), 4, 2, 2)
        told = embeddings.text_embeddings(df, "id", F.col("ws"), vectors, 4).collect()
        return {r.word: r.vector for r in vectors.collect()}, sigma, {r.id: r.embedding for r in told}

    want = run()
    monkeypatch.setattr(embeddings, "COMMON", common)
    got = run()
    assert got[0].keys() == want[0].keys() and got[2].keys() == want[2].keys() and got[2][90] is got[2][91] is None and np.allclose(got[1], want[1])
    assert all(np.allclose(got[0][w], v, atol=1e-8) for w, v in want[0].items())
    assert all((v is None and got[2][i] is None) or np.allclose(got[2][i], v, atol=1e-8) for i, v in want[2].items())


def test_titles_that_only_share_letters_are_not_shuffled_in_pairs(spark):
    """pairs are checked in the join; those that share letters and a piece, but not their order, go no further."""
    import random
    random.seed(5)
    titles = ["abcd" + "".join(random.sample("efghijkl", 8)) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").cache()
    told = []
    n = shuffled(spark, lambda: told.extend(fuzzy.similar_titles(rows, rows, "t", "t", 88.0, once=True).collect()))
    from chronotext.operators.linkage import token_set
    want = {tuple(sorted((a, b))) for a in titles for b in titles if token_set(a, b) >= 88}
    assert {tuple(sorted((r.a, r.b))) for r in told} == want and n < 80_000


def most_read(spark, run):
    """The rows that the largest task of a call reads from a shuffle, with partitions as they are dealt."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).attemptId() for i in range(found.size())}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        before = stages()
        run()
        tasks = [store.taskList(k, at, 1000) for k, at in stages().items() if k not in before]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    metrics = [found.apply(i).taskMetrics() for found in tasks for i in range(found.size())]
    return max(m.get().shuffleReadMetrics().recordsRead() for m in metrics if m.isDefined())


def test_facts_of_a_month_are_dealt_to_tasks(spark):
    """an hour's facts meet in a task, not a month's."""
    facts = spark.range(20_000).select("id", (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97 % 1_000_000)).alias("at")).cache()
    events = spark.range(40).select((F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 25_000)).alias("e_at"), F.col("id").alias("label"))
    told = []
    n = most_read(spark, lambda: told.extend(event_study.proximity(facts, events, "at", "e_at", "label", (3,)).select("id", "label").collect()))
    assert {(r.id, r.label) for r in told} == {(i, i * 97 % 1_000_000 // 25_000) for i in range(20_000)} and n < 12_000


def test_trimmed_means_of_a_group_in_many_tasks(spark):
    """a group's values are dealt by ranges; counts of equal values are cut inside."""
    values = [float(i * 7919 % 6000) for i in range(9000)] + [None, float("nan"), float("inf")]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None), (None, 3.0), ("c", 1.0), ("c", 2.0)], "k string, v double").cache()
    told = {}
    n = most_read(spark, lambda: told.update({r.k: r.trimmed for r in statistics.trimmed_means(df, ["k"], "v", 0.1).collect()}))
    kept = sorted(v for v in values[:9000])[900:8100]
    assert told == {"a": pytest.approx(np.mean(kept)), "b": None, None: 3.0, "c": 1.5} and n < 4500
    assert statistics.trimmed_means(df.where("k = 'c'"), ["k"], "v", 0.5).collect()[0].trimmed is None
    assert "Python" not in queries.QUERIES["trimmed_means"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_f10_f13_syllables_are_counted_once_a_distinct_word(spark):
    rows = [(0, "The table's little whales rhythm 'tis able apple queue".split()), (1, []), (2, None), (3, ["'", "A", "été", "ÉLITE", "syllable", "b c", None]), (4, ["a"] * 5000 + ["beautiful"])]
    df = spark.createDataFrame(rows, "k int, w array<string>").repartition(2)
    w = F.col("w")
    got = {r.k: r for r in df.select("k", lexical.syllable_counts(w).alias("s"), lexical.total(w, lexical.syllables).alias("total"), F.size(F.filter(w, lambda x: lexical.syllables(x) == 1)).alias("one"),
                                     F.size(F.filter(w, lambda x: lexical.syllables(x) >= 3)).alias("many")).collect()}
    assert got[2].s is None and all(tuple(got[k].s) == (got[k].total, got[k].one, got[k].many) for k in (0, 1, 3, 4))
    plan = df.select(lexical.mean_syllables(w), lexical.share_of_one_syllable(w), lexical.share_of_three_syllables(w))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.split("ArrowEvalPython")[1].split("\n")[0].count("syllable_counts(") == 1


def test_f13_grade_takes_syllables_from_the_arrow_function(spark):
    df = spark.createDataFrame([(1, "a little table of apples".split()), (2, []), (3, None)], "k int, w array<string>")
    w = F.col("w")
    n = F.size(w).cast("double")
    plain = F.coalesce(F.round(0.39 * F.try_divide(n, F.lit(2.0)) + 11.8 * F.try_divide(lexical.total(w, lexical.syllables).cast("double"), n) - 15.59, 2), F.lit(0.0))
    out = df.select(lexical.flesch_kincaid(w, F.lit(2)).alias("a"), plain.alias("b"))
    assert all(r.a == r.b for r in out.collect())
    plan = df.select(lexical.mean_syllables(w), lexical.flesch_kincaid(w, F.lit(2)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "aggregate(" not in plan


def test_f15_a_small_lexicon_goes_to_the_words(spark, monkeypatch):
    texts = ["the very good one", "not a really good bad good", "good " * 50, "", None, "bad not bad so slightly bad good"]
    df = spark.createDataFrame([(i, t.split() if t is not None else None) for i, t in enumerate(texts)], "k int, ws array<string>").repartition(3)
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -1.5), ("the", 0.25)], "term string, valence double")
    small = models.sentiment(df, ["k"], F.col("ws"), lexicon)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(") == 1
    monkeypatch.setattr(models, "SENT", 2)
    large = {r.k: tuple(r)[1:] for r in models.sentiment(df, ["k"], F.col("ws"), lexicon).collect()}
    assert {r.k for r in small.collect()} == set(large) == {0, 1, 2, 5}
    assert all(np.allclose(tuple(r)[1:], large[r.k], atol=1e-12) for r in small.collect())


def test_f12_topics_put_only_first_words_into_a_plan(spark):
    words = [f"word{i:03d}" for i in range(300)]
    df = spark.createDataFrame([(i, [words[(i * 7 + j) % 300] for j in range(40)]) for i in range(60)], "k int, ws array<string>").repartition(2)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assigned, named = models.topics(df, "k", F.col("ws"), k=2)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    rows = named.collect()
    assert assigned.count() == 60 and [r.topic for r in rows] == [0, 1] and all(len(set(r.top_words)) == 10 and set(r.top_words) <= set(words) for r in rows)
    plan = named._jdf.queryExecution().analyzed().toString()
    assert sum(w in plan for w in words) <= 20


def test_f16_features_go_in_small_batches(spark):
    texts = ["it's a b b" * (i % 3) + f" w{i}" for i in range(1000)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(texts), pa.int32()), pa.array(texts), pa.array(range(len(texts)), pa.int64())], names=["label", "text", "n"])
    out = list(linear._featured(16)(iter([batch.slice(1), batch.slice(0, 0)])))
    assert max(map(len, out)) <= 256
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["n"] for r in rows] == [*range(1, len(texts))]
    for t, r in zip(texts[1:], rows):
        at, x = linear.features(t)
        assert r["at"] == at.tolist() and r["x"] == x.tolist()
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    sizes = models.score_rows(df, "t", lambda: lambda part: [(len(part), [1.0, None])] * len(part), "size int, held array<double>", batch=100).collect()
    assert [r.t for r in sizes] == texts and sizes[-2].size is None and sizes[-2].held is None and sizes[0].held == [1.0, None] and {r.size for r in sizes if r.t is not None} == {1, 100}


def test_f8_sentences_of_all_lengths_share_a_step(spark):
    random = np.random.default_rng(3)
    model = tagging.first_model({s: 1.0 + i for i, s in enumerate(("the", "-ing", "-ion", "#", "i", "of", "-~n~"))})
    names = [*model.names, "-new"]
    held = [[names[k] for k in random.integers(0, len(names), n)] for n in random.permutation([0, *range(60), 1, 1, 700])]
    column = pa.array([["skipped"], *held], pa.list_(pa.string())).slice(1)
    column = pa.ListArray.from_arrays(pa.array(column.offsets.to_numpy() - 1, pa.int32()), column.values.slice(1))
    blocks = list(tagging._packed(model, column))
    assert sum(len(sizes) for *_, sizes in blocks) == 700 and sorted(np.concatenate([w for _, w, _, _ in blocks]).tolist()) == list(range(len(column.values)))
    for rows, where, x, sizes in blocks:
        tags, log, before, after = tagging.packed_passes(model, x, sizes)
        best, row = tagging.packed_tags(tagging.logs(model), x, sizes), tagging._row(sizes)
        for i, r in enumerate(rows):
            alone = np.array([[model.names.get(s, len(model.names)) for s in held[r]]])
            t, l, b, a = tagging.passes(model, alone)
            assert np.allclose(tags[row == i], t[0]) and np.isclose(log[i], l[0]) and (best[row == i] == tagging.best_tags(model, alone)[0]).all()
            assert np.allclose(before[row[sizes[0] :] == i], b[0]) and np.allclose(after[row[sizes[0] :] == i], a[0])
    plan = tagging.sentences(spark.createDataFrame([(1, "A b. c!")], "k int, t string"), "k", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
