"""Tagger: passes and Viterbi against all tag sequences, distributed rounds against one process, filters on tags."""
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronotext.operators import tagging

TEXTS = ["The old dog barked at the cat. I saw it and I was happy!", "She is running to the house\nMy nation needs 42 beautiful things", "they quickly made a decision about us", None, "", "!!!", "東京 était là, I'm sure"] * 3 + ["the " * 300]


def model_of(spark, rounds=0):
    df = tagging.sentences(spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "k int, t string, words string").repartition(3), "k", "t")
    return df, tagging.fit(df, rounds=rounds)


def all_sequences(model, x):
    """(probability, tags) of every tag sequence of one sequence of places."""
    for tags in itertools.product(range(tagging.K), repeat=len(x)):
        p = model.start[tags[0]] * model.shows[x[0], tags[0]]
        for t in range(1, len(x)):
            p *= model.moves[tags[t - 1], tags[t]] * model.shows[x[t], tags[t]]
        yield p, tags


def test_passes_and_viterbi_against_all_sequences(spark):
    _, model = model_of(spark, 1)
    random = np.random.default_rng(1)
    for length in (1, 2, 4):
        x = random.integers(0, len(model.names) + 1, (5, length))
        tags, log, before, after = tagging.passes(model, x)
        best = tagging.best_tags(model, x)
        for i in range(len(x)):
            every = list(all_sequences(model, x[i]))
            total = sum(p for p, _ in every)
            assert abs(np.log(total) - log[i]) < 1e-8
            want, between = np.zeros((length, tagging.K)), np.zeros((tagging.K, tagging.K))
            for p, s in every:
                for t, k in enumerate(s):
                    want[t, k] += p / total
                for a, b in zip(s, s[1:]):
                    between[a, b] += p / total
            assert np.allclose(tags[i], want, atol=1e-9) and np.allclose(tagging.expected_moves(model, before[i : i + 1], after[i : i + 1], np.ones(1)), between, atol=1e-9)
            assert abs(max(p for p, _ in every) - next(p for p, s in every if s == tuple(best[i]))) < 1e-15


def test_rounds_equal_one_process_and_climb(spark):
    df, model = model_of(spark, 4)
    assert all(b >= a - 1e-6 for a, b in zip(model.likelihoods, model.likelihoods[1:])) and len(model.likelihoods) == 4
    seen = [[tagging.symbol(w) for w in r.words] for r in df.collect()]
    counts = {}
    for s in itertools.chain(*seen):
        counts[s] = counts.get(s, 0) + 1.0
    own = tagging.first_model(counts)
    for _ in range(4):
        start, moves, shows = np.zeros(tagging.K), np.zeros((tagging.K, tagging.K)), np.zeros_like(own.shows)
        for s in seen:
            x = np.array([own.names[c] for c in s])
            tags, _, before, after = tagging.passes(own, x[None])
            start += tags[0, 0]
            moves += tagging.expected_moves(own, before, after, np.ones(1))
            np.add.at(shows, x, tags[0])
        own = tagging.next_model(own, start, moves, shows)
    assert own.names == model.names
    for a, b in ((own.start, model.start), (own.moves, model.moves), (own.shows, model.shows)):
        assert np.allclose(a, b, atol=1e-9)


def test_tags(spark):
    df, model = model_of(spark, 5)
    rows = {tuple(r.words): r.tags for r in tagging.tagged(df, model).collect()}
    one = rows[("the", "old", "dog", "barked", "at", "the", "cat")]
    assert one[0] == one[5] == "DET" and one[4] == "ADP" and one[6] == "NOUN"
    assert rows[("i", "saw", "it", "and", "i", "was", "happy")][0] == "PRON" and rows[("i", "saw", "it", "and", "i", "was", "happy")][5] == "AUX"
    assert all(len(w) == len(t) for w, t in rows.items()) and len(rows[("the",) * 300]) == 300
    extra = spark.createDataFrame([(None,), ([],), (["zyx", "qqq"],)], "words array<string>")
    got = [r.tags for r in tagging.tagged(extra, model).collect()]
    assert got[:2] == [[], []] and set(got[2]) <= set(tagging.OPEN)


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "words array<string>")
    model = tagging.fit(empty)
    assert tagging.tagged(empty, model).collect() == [] and [r.tags for r in tagging.tagged(spark.createDataFrame([(["the", "dog"],)], "words array<string>"), model).collect()][0][1] in tagging.OPEN


def test_symbols_are_few():
    words = pa.array([["The", "I’m", "42nd", "running", "Ünï", "ox", "東京", None], None, []], pa.list_(pa.string()))
    assert tagging.symbols(words).to_pylist() == [["the", "i'm", "#", "-ing", "-~n~", "-ox", "-~~", "-"], [], []]


def test_filters(spark):
    rows = [("i we run the big dogs running here".split(), "PRON PRON VERB DET ADJ NOUN VERB ADV".split()), ("my mine i me i'm is is be".split(), ["PRON"] * 5 + ["VERB"] * 3), ([], []), (None, None), ("a b c d e f g".split(), ["NOUN"] * 7)]
    df = spark.createDataFrame(rows, "w array<string>, t array<string>")
    w, t = F.col("w"), F.col("t")
    got = [tuple(r) for r in df.select(tagging.varied(w, t), tagging.lexical_line(w, t), tagging.pronoun_line(w, t, 0.5), F.round(tagging.morphological_rate(w, t), 6), tagging.content_words(t)).collect()]
    assert got == [(True, True, True, 0.125, 4), (True, True, False, 0.625, 3), (False, False, False, 0.0, 0), (False, False, False, 0.0, 0), (True, True, False, 0.0, 7)]
