"""Parts of speech by a hidden Markov model that is fitted to the corpus itself.

A word is known by its *symbol*: itself if it is one of the closed classes' (``CLOSED``), ``#`` for numbers, else its
last three letters.  Letters beyond a to z count as one, so there are at most about 21,000 symbols whatever the corpus:
the model's tables have a fixed bound and can be sent to every task.

Baum-Welch: each round the sentences, distinct in their symbols and counted, go through scaled forward and backward
passes in Arrow batches; a task sends the expected counts of starts, transitions and symbols, Spark adds them up, and
the driver divides them.  Closed words keep to their tags (a probability of zero stays zero), suffixes start from
``ENDINGS``, and transitions from ``USUAL``.  What they start from also stays as a prior of ``PRIOR`` counts for each
symbol and tag, so that rare symbols keep to it while frequent ones follow the corpus; each round raises the likelihood
times the prior.  All sentences count in every round.

Null and empty sentences have no tags.  Symbols that were not seen in fitting may be any open class.
"""
import dataclasses
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = ("NOUN", "VERB", "ADJ", "ADV", "PRON", "DET", "ADP", "CONJ", "AUX", "PART", "NUM")
OPEN = {"NOUN": 6.0, "VERB": 3.0, "ADJ": 2.0, "ADV": 0.5}  # and what speaks for them before anything is seen
# Words of the closed classes of English.
CLOSED = {
    "PRON": "i me my mine myself you your yours yourself yourselves he him his himself she her hers herself it its itself we us our ours ourselves they them their theirs themselves who whom whose what which this that these those someone anyone everyone nobody something anything everything nothing i'm i've i'd i'll you're you've we're they're it's he's she's",
    "DET": "a an the this that these those my your his her its our their some any no every each all both either neither another",
    "ADP": "of in on at by for from with about into over under after before between through during without within against among around behind beside near off out up down to upon like",
    "CONJ": "and or but nor so yet because if while when where although though since unless until than as whether that",
    "AUX": "am is are was were be been being have has had having do does did can could will would shall should may might must ain't isn't aren't wasn't weren't don't doesn't didn't can't couldn't won't wouldn't",
    "PART": "to not n't 's",
    "ADV": "very really too also just never always often here there now then again soon still only even ever away back",
    "NUM": "one two three four five six seven eight nine ten hundred thousand million",
}
# What an ending speaks for at first.
ENDINGS = {"ing": "VERB", "ed": "VERB", "ize": "VERB", "ise": "VERB", "ate": "VERB", "ly": "ADV", "ous": "ADJ", "ful": "ADJ", "ive": "ADJ", "ble": "ADJ", "ish": "ADJ", "ess": "NOUN", "ion": "NOUN", "ent": "NOUN", "ism": "NOUN", "ity": "NOUN", "er": "NOUN", "or": "NOUN", "s": "NOUN"}
USUAL = (("DET", "NOUN"), ("DET", "NOUN"), ("DET", "NOUN"), ("DET", "ADJ"), ("ADJ", "NOUN"), ("ADJ", "NOUN"), ("PRON", "VERB"), ("PRON", "AUX"), ("AUX", "VERB"), ("ADP", "DET"), ("ADP", "NOUN"), ("VERB", "DET"), ("VERB", "ADP"), ("NOUN", "VERB"), ("NOUN", "ADP"), ("PART", "VERB"), ("NUM", "NOUN"), ("ADV", "ADJ"), ("ADV", "VERB"))
COPULAS = ("be", "am", "is", "are", "was", "were", "been", "being", "'m", "’m")
FIRST_SINGULAR = ("i", "me", "my", "mine", "myself", "i'm", "i've", "i'd", "i'll")
K = len(TAGS)
FLOOR = 1e-12
PRIOR = 4.0


def closed_tags() -> dict[str, list[str]]:
    out = {}
    for tag, words in CLOSED.items():
        for w in words.split():
            out.setdefault(w, []).append(tag)
    return out


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, words): the sentences of each text, cut at stops and line ends, with lower-case words in order."""
    parts = F.split(F.lower(F.col(text)), r"[.!?\n]+")
    words = F.regexp_extract_all(F.col("part"), F.lit(r"([\p{L}\p{N}'’]+)"))
    held = F.col("part").rlike(r"[\p{L}\p{N}'’]")  # a condition on the number of words would make Spark find them twice
    return df.select(key, F.posexplode(parts).alias("place", "part")).where(held).select(key, "place", words.alias("words"))


_CLOSED = closed_tags()


@functools.lru_cache(1 << 16)
def symbol(word: str) -> str:
    plain = word.lower().replace("’", "'")
    if plain in _CLOSED:
        return plain
    if "0" <= plain[:1] <= "9":
        return "#"
    return "-" + "".join(c if "a" <= c <= "z" else "~" for c in plain[-3:])


def symbols(column: pa.ListArray) -> pa.ListArray:
    """The symbol of each word of an Arrow column of arrays, worked out once for each distinct word of a batch."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, []) if column.null_count else column
    held = column.flatten().dictionary_encode()
    named = pa.array([symbol(w) for w in held.dictionary.to_pylist()], pa.string())
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pc.fill_null(named.take(held.indices), "-"))


def _symbols(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([symbols(batch.column(0))], names=["s"])


@dataclasses.dataclass
class Model:
    """Start (K), transitions (K x K) and symbols (one row each, the last for unseen ones) in probabilities."""
    names: dict
    start: np.ndarray
    moves: np.ndarray
    shows: np.ndarray
    prior: tuple = ()
    likelihoods: list = dataclasses.field(default_factory=list)


def first_model(counts: dict[str, float]) -> Model:
    """The model that fitting starts from, given how often each symbol occurs."""
    names = {s: i for i, s in enumerate(sorted(counts))}
    closed, shares = closed_tags(), np.zeros((len(names) + 1, K))
    open_tags = [TAGS.index(t) for t in OPEN]
    for s, i in names.items():
        if s in closed:
            shares[i, [TAGS.index(t) for t in closed[s]]] = 1
        elif s == "#":
            shares[i, TAGS.index("NUM")] = 1
        else:
            shares[i, open_tags] = [*OPEN.values()]
            hint = next((t for e, t in ENDINGS.items() if s.endswith(e)), None)
            if hint:
                shares[i, TAGS.index(hint)] += 40
    shares[-1, open_tags] = [*OPEN.values()]
    shares /= shares.sum(1, keepdims=True)
    shows = shares * np.array([*(counts[s] for s in names), 1.0])[:, None]
    moves = np.tile([OPEN.get(t, 1.0) / 2 for t in TAGS], (K, 1))
    for a, b in USUAL:
        moves[TAGS.index(a), TAGS.index(b)] += 8
    moves /= moves.sum(1, keepdims=True)
    prior = (np.full(K, PRIOR / K), moves * PRIOR * K, shares * PRIOR)
    return _whole(Model(names, np.ones(K), moves, shows, prior))


def next_model(model: Model, start, moves, shows) -> Model:
    """The model of expected counts, with the prior of the one before."""
    a, b, c = model.prior
    return _whole(Model(model.names, start + a, moves + b, shows + c, model.prior, list(model.likelihoods)))


def log_prior(model: Model) -> float:
    return float(sum((p[p > 0] * np.log(np.maximum(q[p > 0], 1e-300))).sum() for p, q in zip(model.prior, (model.start, model.moves, model.shows))))


def _whole(model: Model) -> Model:
    """Counts to probabilities; a tag without any count shows nothing."""
    model.start = np.maximum(model.start / max(model.start.sum(), FLOOR), FLOOR)
    model.moves = np.maximum(model.moves / np.maximum(model.moves.sum(1, keepdims=True), FLOOR), FLOOR)
    model.moves /= model.moves.sum(1, keepdims=True)
    model.shows = model.shows / np.maximum(model.shows.sum(0, keepdims=True), FLOOR)
    return model


def _packed(model: Model, column: pa.ListArray, most=1 << 16):
    """(rows, where their symbols lie, places of these, sizes) of an Arrow column of arrays of symbols, in blocks of about
    ``most`` symbols.  Rows go by falling length and symbols by step: first all first symbols, then all second ones; a
    size says how many rows have a symbol at that step.  So sentences of all lengths share a step."""
    offsets, seen = column.offsets.to_numpy(), pa.array(list(model.names), pa.string())
    at = pc.fill_null(pc.index_in(column.values, value_set=seen), len(seen)).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")[: np.count_nonzero(lengths)]
    block = np.cumsum(np.maximum(lengths[order], 16)) // most
    for rows in np.split(order, np.flatnonzero(np.diff(block)) + 1) if len(order) else ():
        sizes = np.cumsum(np.bincount(lengths[rows])[:0:-1])[::-1]
        step = np.repeat(np.arange(len(sizes)), sizes)
        where = offsets[rows][_row(sizes)] + step
        yield rows, where, at[where], sizes


def _row(sizes):
    """The row of each symbol of a block."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _whole_block(x: np.ndarray):
    """Sequences of one length (n x length) as a block: places by step, and sizes."""
    return x.T.ravel(), np.full(x.shape[1], len(x))


def _by_row(x: np.ndarray, held: np.ndarray, less=0):
    """A block's numbers of sequences of one length, by row again."""
    return held.reshape(x.shape[1] - less, len(x), *held.shape[1:]).swapaxes(0, 1)


def packed_passes(model: Model, x: np.ndarray, sizes: np.ndarray):
    """Scaled forward and backward passes over a block (places by step, sizes): posteriors of the tags (one row a symbol),
    log likelihoods (one a row of the block), and what comes before and after each move (one row a symbol after the first
    step)."""
    ends = np.cumsum(sizes)
    shows, ones = model.shows[x], np.ones(K)
    ahead, back, right, scale = np.empty_like(shows), np.ones_like(shows), np.empty_like(shows), np.empty(len(x))
    for t, (b, n) in enumerate(zip(ends.tolist(), sizes.tolist())):
        a = ahead[b - n : b]
        if t:
            np.matmul(ahead[was : was + n], model.moves, out=a)
            a *= shows[b - n : b]
        else:
            np.multiply(shows[:b], model.start, out=a)
        total = a @ ones
        lost = total <= 0  # what the model can't show: every tag alike
        if lost.any():
            a[lost], total[lost] = 1.0, K
            scale[b - n : b] = np.where(lost, FLOOR, total)
        else:
            scale[b - n : b] = total
        a /= total[:, None]
        was = b - n
    shows /= scale[:, None]
    for t in range(len(sizes) - 1, 0, -1):
        b, n = ends[t], sizes[t]
        r, before = right[b - n : b], b - n - sizes[t - 1]
        np.multiply(shows[b - n : b], back[b - n : b], out=r)
        c = np.matmul(r, model.moves.T, out=back[before : before + n])
        none = c @ ones <= 0
        if none.any():
            c[none] = 1
    tags = ahead * back
    tags /= (tags @ ones)[:, None]
    first, moved = sizes[0], np.arange(sizes[0], len(x)) - np.repeat(sizes[:-1], sizes[1:])
    return tags, np.bincount(_row(sizes), weights=np.log(scale), minlength=first), ahead[moved], right[first:]


def passes(model: Model, x: np.ndarray):
    """Scaled forward and backward passes over sequences (n x length of places): posteriors of the tags (n x length x
    K), log likelihoods (n), and what comes before and after each move (n x length - 1 x K each)."""
    tags, log, before, after = packed_passes(model, *_whole_block(x))
    return _by_row(x, tags), log, _by_row(x, before, 1), _by_row(x, after, 1)


def expected_moves(model: Model, before: np.ndarray, after: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected counts of moves (K x K) of sequences that count ``weight`` times."""
    return model.moves * ((before * weight[:, None, None]).reshape(-1, K).T @ after.reshape(-1, K))


def logs(model: Model):
    """Logarithms of a model's start, transitions and symbols (one column each)."""
    with np.errstate(divide="ignore"):
        return np.log(model.start), np.log(model.moves), np.maximum(np.log(np.ascontiguousarray(model.shows.T)), -1e9)


def packed_tags(known, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Viterbi over a block, given a model's ``logs``: the likeliest tag of each symbol; of equal ones the first in
    ``TAGS``, from the end back.  The way back is found again from the scores, for one tag of a row instead of all."""
    start, moves, shows = known
    ends, score = np.cumsum(sizes).tolist(), shows[:, x]
    score[:, : sizes[0]] += start[:, None]
    for t in range(1, len(sizes)):
        a, b = ends[t - 1], ends[t]
        was = a - sizes[t - 1]
        score[:, a:b] += (score[:, None, was : was + b - a] + moves[:, :, None]).max(0)
    out, into = np.empty(len(x), np.int64), np.ascontiguousarray(moves.T)
    for t in range(len(sizes) - 1, -1, -1):
        b, n = ends[t], sizes[t]
        going = sizes[t + 1] if t + 1 < len(sizes) else 0
        held = score[:, b - n : b].T.copy()
        held[:going] += into[out[b : b + going]]
        out[b - n : b] = held.argmax(1)
    return out


def best_tags(model: Model, x: np.ndarray) -> np.ndarray:
    """Viterbi: the likeliest tags of sequences (n x length); of equal ones the first in ``TAGS``, from the end back."""
    return _by_row(x, packed_tags(logs(model), *_whole_block(x)))


def _counted(shipped):
    """Expected counts of a task: rows (part, place, K numbers); parts are starts, moves, symbols and log likelihood."""
    def counted(batches):
        model = shipped.value
        start, moves, shows, likelihood = np.zeros(K), np.zeros((K, K)), np.zeros_like(model.shows), 0.0
        for batch in batches:
            weights, at, of = batch.column(1).to_numpy().astype(float), [], []
            for rows, _, x, sizes in _packed(model, batch.column(0)):
                w = weights[rows][_row(sizes)][:, None]
                tags, log, before, after = packed_passes(model, x, sizes)
                tags *= w
                start += tags[: sizes[0]].sum(0)
                before *= w[sizes[0] :]
                moves += model.moves * (before.T @ after)
                likelihood += float(weights[rows] @ log)
                at.append(x)
                of.append(tags)
            if at:
                at, of = np.concatenate(at), np.concatenate(of)
                for k in range(K):
                    shows[:, k] += np.bincount(at, weights=of[:, k], minlength=len(shows))
        parts = [(0, 0, start), *((1, i, r) for i, r in enumerate(moves)), *((2, int(i), shows[i]) for i in np.flatnonzero(shows.any(1))), (3, 0, np.array([likelihood] + [0.0] * (K - 1)))]
        columns = [pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32())] + [pa.array([float(p[2][k]) for p in parts]) for k in range(K)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "place", *(f"c{k}" for k in range(K))])
    return counted


def fit(df: DataFrame, words: str = "words", rounds: int = 8) -> Model:
    """A model of the sentences of a column of word arrays; ``likelihoods`` holds the log of likelihood times prior before each
    round."""
    spark = df.sparkSession
    patterns = df.select(words).where(F.size(words) > 0).mapInArrow(_symbols, "s array<string>").groupBy("s").agg(F.count("*").alias("n")).persist(StorageLevel.DISK_ONLY)
    try:
        model = first_model({r["x"]: float(r["n"]) for r in patterns.select(F.explode("s").alias("x"), "n").groupBy("x").agg(F.sum("n").alias("n")).collect()})
        kinds = "part int, place int, " + ", ".join(f"c{k} double" for k in range(K))
        for _ in range(rounds if model.names else 0):
            shipped = spark.sparkContext.broadcast(model)
            sums = patterns.mapInArrow(_counted(shipped), kinds).groupBy("part", "place").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(K))).collect()
            start, moves, shows = np.zeros(K), np.zeros((K, K)), np.zeros_like(model.shows)
            for r in sums:
                row = np.array(r[2:])
                if r["part"] == 0:
                    start = row
                elif r["part"] == 3:
                    model.likelihoods.append(float(row[0]) + log_prior(model))
                else:
                    (moves if r["part"] == 1 else shows)[r["place"]] = row
            model = next_model(model, start, moves, shows)
            shipped.unpersist()
        return model
    finally:
        patterns.unpersist()


def tagged(df: DataFrame, model: Model, words: str = "words", out: str = "tags") -> DataFrame:
    """Adds the tag of each word."""
    shipped, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(words)

    def tag(batches):
        names, known = pa.array(TAGS), logs(shipped.value)
        for batch in batches:
            seen = symbols(batch.column(at))
            tags = np.zeros(len(seen.values), np.int64)
            for _, where, x, sizes in _packed(shipped.value, seen):
                tags[where] = packed_tags(known, x, sizes)
            made = pa.ListArray.from_arrays(seen.offsets, names.take(pa.array(tags)))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return df.mapInArrow(tag, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))]))


def _pairs(words: Column, tags: Column) -> Column:
    return F.arrays_zip(words.alias("w"), tags.alias("t"))


def count_tags(tags: Column, *kinds: str) -> Column:
    return F.coalesce(F.size(F.filter(tags, lambda t: t.isin(*kinds))), F.lit(0))


def content_words(tags: Column) -> Column:
    """Nouns, verbs and adjectives."""
    return count_tags(tags, "NOUN", "VERB", "ADJ")


def varied(words: Column, tags: Column) -> Column:
    """At least 6 words, 4 of them and half of them distinct, and 2 content words."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return F.coalesce((n >= 6) & (distinct >= 4) & (distinct >= 0.5 * n) & (content_words(tags) >= 2), F.lit(False))


def base_form(word: Column) -> Column:
    """A word without a verb's or a plural's ending."""
    return F.regexp_replace(F.regexp_replace(F.lower(word), r"(?<=[a-z]{3})(?:ing|ed|es|s)$", ""), r"(?<=[a-z]{2})([^aeiouls])\1$", "$1")


def lexical_line(words: Column, tags: Column) -> Column:
    """At least 6 words, 4 of them distinct, and nouns or verbs of 2 base forms."""
    held = F.array_distinct(F.transform(F.filter(_pairs(words, tags), lambda p: p["t"].isin("NOUN", "VERB")), lambda p: p["w"]))
    return F.coalesce((F.size(words) >= 6) & (F.size(F.array_distinct(words)) >= 4) & (F.size(F.array_distinct(F.transform(held, base_form))) >= 2), F.lit(False))


def first_singular_share(words: Column) -> Column:
    """Share of words of the first person singular, by their form."""
    mine = F.filter(words, lambda w: F.lower(w).isin("i", "me", "my", "mine", "myself") | F.lower(w).rlike("^i['’]"))
    return F.when(F.size(words) > 0, F.size(mine) / F.size(words)).otherwise(0.0)


def pronoun_line(words: Column, tags: Column, most: float) -> Column:
    """At least 7 words, 4 of them distinct, a first-person share of at most ``most``, a noun, and a verb that isn't a
    copula."""
    verb = F.exists(_pairs(words, tags), lambda p: (p["t"] == "VERB") & ~F.lower(p["w"]).isin(*COPULAS))
    return F.coalesce((F.size(words) >= 7) & (F.size(F.array_distinct(words)) >= 4) & (first_singular_share(words) <= most) & F.array_contains(tags, "NOUN") & verb, F.lit(False))


def morphological_rate(words: Column, tags: Column) -> Column:
    """Pronouns of the first person singular for each word; a form that is tagged otherwise doesn't count."""
    mine = F.filter(_pairs(words, tags), lambda p: (p["t"] == "PRON") & F.lower(F.translate(p["w"], "’", "'")).isin(*FIRST_SINGULAR))
    return F.coalesce(F.size(mine), F.lit(0)) / F.greatest(F.coalesce(F.size(words), F.lit(0)), F.lit(1))
