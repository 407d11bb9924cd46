"""The distributed difference cover against plain sorting and counting."""
import random
from collections import Counter

import pytest

from chronotext.llm import difference_cover


def plain_ranks(s):
    return {p: r for r, p in enumerate(sorted(range(len(s)), key=lambda i: s[i:]))}


@pytest.mark.parametrize("n", [6, 7, 8, 40])
def test_ranks_equal_sorted_suffixes(spark, n):
    """Every remainder modulo 3; few symbols, so that names repeat and the rounds recurse."""
    random.seed(n)
    s = [random.choice([1, 2]) for _ in range(n)]
    levels = []
    got = difference_cover.suffix_ranks(spark.createDataFrame(list(enumerate(s)), "p long, c long"), n, base=5, levels=levels)
    assert {r.p: r.r for r in got.collect()} == plain_ranks(s) and (n < 40 or len(levels) > 2)


def test_places_equal_counted_strings(spark):
    random.seed(8)
    passage = "".join(random.choice("ab ") for _ in range(30))
    texts = ["".join(random.choice("abé") for _ in range(random.randint(0, 25))) + random.choice([passage, "", passage[:12]]) for _ in range(9)]
    texts += [None, "", texts[2], "x" * 25]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, place int")
    length, data = 10, [(t or "").encode() for t in texts]
    times = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    expected, start = set(), 0
    for t in data:
        expected |= {start + i for i in range(len(t) - length + 1) if times[t[i : i + length]] > 1}
        start += len(t) + 1
    places, _ = difference_cover.repeated_places(df, length, base=60)
    assert {r.p for r in places.collect()} == expected
    assert difference_cover.repeated_places(df.limit(0), length)[0].count() == 0
