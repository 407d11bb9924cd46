"""Lexical measures over arrays of words."""
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

DRAWS = 42


def syllables(word: Column) -> Column:
    """Vowel groups of a word's letters, less one for a final e, one more for -le after a consonant; one at least, and
    none without letters."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(letters, F.lit("[aeiouy]+"))
    silent = F.endswith(letters, F.lit("e")) & (groups > 1)
    return F.when(letters == "", 0).otherwise(F.greatest(F.lit(1), groups - silent.cast("int") + letters.rlike("[^aeiouy]le$").cast("int")))


@F.arrow_udf(StructType().add("total", LongType()).add("one", LongType()).add("many", LongType()))
def syllable_counts(words: pa.Array) -> pa.Array:
    """The syllables of all words, and how many words have one, and three or more; null for a null array.

    An Arrow-batched function, in which each distinct word of a batch is looked at once; it counts as ``syllables`` does."""
    held = words.flatten().dictionary_encode()
    letters = pc.replace_substring_regex(pa.array([None if w is None else w.lower() for w in held.dictionary.to_pylist()], pa.string()), "[^a-z]", "")
    groups = pc.count_substring_regex(letters, "[aeiouy]+").to_numpy(zero_copy_only=False)
    silent = pc.ends_with(letters, "e").to_numpy(zero_copy_only=False).astype(bool) & (groups > 1)
    more = pc.match_substring_regex(letters, "[^aeiouy]le$").to_numpy(zero_copy_only=False).astype(bool)
    each = np.where(pc.binary_length(letters).to_numpy(zero_copy_only=False) == 0, 0, np.maximum(1, groups - silent + more))
    of = np.append(each, 1).astype(np.int64)[pc.fill_null(held.indices, len(each)).to_numpy(zero_copy_only=False)]  # a null word counts as 1
    ends = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)]))
    sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (of, of == 1, of >= 3)]
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in sums], names=["total", "one", "many"], mask=pc.is_null(words))


def total(words: Column, f) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + f(w))


def type_token_ratio(words: Column) -> Column:
    return F.try_divide(F.size(F.array_distinct(words)).cast("double"), F.size(words).cast("double"))


def mean_length(words: Column) -> Column:
    return F.try_divide(total(words, F.length).cast("double"), F.size(words).cast("double"))


def mean_syllables(words: Column) -> Column:
    return F.try_divide(syllable_counts(words)["total"].cast("double"), F.size(words).cast("double"))


def share_of_one_syllable(words: Column) -> Column:
    return F.try_divide(syllable_counts(words)["one"].cast("double"), F.size(words).cast("double"))


def share_of_three_syllables(words: Column) -> Column:
    """Share of words of three syllables or more."""
    return F.try_divide(syllable_counts(words)["many"].cast("double"), F.size(words).cast("double"))


def share(words: Column, condition) -> Column:
    return F.try_divide(F.size(F.filter(words, condition)).cast("double"), F.size(words).cast("double"))


def flesch_kincaid(words: Column, sentences: Column, digits: int = 2) -> Column:
    """The reading grade, rounded; 0 without words or sentences."""
    n = F.size(words).cast("double")
    grade = 0.39 * F.try_divide(n, sentences.cast("double")) + 11.8 * F.try_divide(syllable_counts(words)["total"].cast("double"), n) - 15.59
    return F.coalesce(F.round(grade, digits), F.lit(0.0))


def diversity_factors(words, threshold: float) -> float:
    """Factors of one pass over words: full ones, and the part of the last."""
    factors, n, seen = 0.0, 0, set()
    for w in words:
        n += 1
        seen.add(w)
        if len(seen) / n <= threshold:
            factors, n, seen = factors + 1, 0, set()
    return factors + (1 - len(seen) / n) / (1 - threshold) if n else factors


def mtld(words: Column, threshold: float = 0.72, least: int = 50, digits: int = 2) -> Column:
    """Mean of the forward and the backward measure of textual lexical diversity, rounded; 0 below ``least``
    words, and a pass without any factor counts as 0.

    An Arrow-batched function, linear in the words: a native fold would search an array at each word."""
    @F.pandas_udf(DoubleType())
    def measure(batch: pd.Series) -> pd.Series:
        def one(ws):
            if ws is None or len(ws) < max(least, 1):
                return None if ws is None else 0.0
            passes = [diversity_factors(x, threshold) for x in (ws, ws[::-1])]
            return round(sum(len(ws) / f if f > 0 else 0.0 for f in passes) / 2, digits)
        return batch.map(one).astype("float64")
    return measure(words)


@F.pandas_udf(DoubleType())
def hdd(words: pd.Series) -> pd.Series:
    """Sum over types of the chance that a draw of 42 words without replacement holds the type, by 42; null below that.

    An Arrow-batched function: a native fold would go over all words once for each type."""
    def one(ws):
        n = 0 if ws is None else len(ws)
        if n < DRAWS:
            return None
        place = np.arange(DRAWS)
        counts, types = np.unique(np.array(list(Counter(ws).values())), return_counts=True)
        missed = np.prod(np.clip((n - counts[:, None] - place) / (n - place), 0, None), axis=1)
        return float(((1 - missed) * types).sum() / DRAWS)
    return words.map(one)


@F.pandas_udf(DoubleType())
def vocd(words: pd.Series) -> pd.Series:
    """The D that fits mean type-token ratios of samples of 35 to 50 words best, from 100 seeded samples a size."""
    def one(ws):
        if ws is None or len(ws) < 50:
            return None
        ids = np.unique(np.array(list(ws)), return_inverse=True)[1]
        random = np.random.default_rng(zlib.crc32("\0".join(ws).encode()))
        sizes = np.arange(35, 51)
        seen = np.array([np.mean([len(np.unique(random.choice(ids, n, replace=False))) / n for _ in range(100)]) for n in sizes])
        grid = np.exp(np.linspace(np.log(1), np.log(400), 2000))
        fit = grid[:, None] / sizes * (np.sqrt(1 + 2 * sizes / grid[:, None]) - 1)
        return float(grid[((fit - seen) ** 2).sum(axis=1).argmin()])
    return words.map(one)


# The words of each category; contractions count as their roots, with and without the apostrophe.
PRONOUNS = {
    "first_singular": ("i", "me", "my", "mine", "myself", "im", "i'm", "ill", "i'll", "ive", "i've", "id", "i'd"),
    "first_plural": ("we", "us", "our", "ours", "were", "we're", "well", "we'll", "weve", "we've"),
    "second": ("you", "your", "yours", "youre", "you're", "youll", "you'll", "yall", "y'all"),
    "third_plural": ("they", "them", "their", "theirs", "theyre", "they're"),
}
FIRST_SINGULAR = ("i", "me", "my", "mine", "myself")
PRONOUN_TOKENS = "[a-z]+'?[a-z]+|[a-z]+"


def pronoun_counts(words: Column, categories: dict = PRONOUNS) -> list[Column]:
    """One count per category."""
    return [F.size(F.filter(words, _among(s))).alias(name) for name, s in categories.items()]


def pronoun_rates(words: Column, categories: dict = PRONOUNS) -> list[Column]:
    """One share of all words per category; 0 without words."""
    n = F.size(words).cast("double")
    return [F.coalesce(F.try_divide(F.size(F.filter(words, _among(s))).cast("double"), n), F.lit(0.0)).alias(f"rate_{name}") for name, s in categories.items()]


def first_person_share(words: Column) -> Column:
    """Share of words that are a first person singular pronoun or a contraction of ``i``; 0 without words."""
    mine = F.filter(words, lambda w: w.isin(*FIRST_SINGULAR) | w.rlike("^i['’]"))
    return F.coalesce(F.try_divide(F.size(mine).cast("double"), F.size(words).cast("double")), F.lit(0.0))


def line_measures(words: Column) -> list[Column]:
    """Tokens of a line and their mean length (null without any)."""
    return [F.size(words).alias("line_tokens"), mean_length(words).alias("mean_word_chars")]


def _among(names):
    return lambda w: w.isin(*names)
