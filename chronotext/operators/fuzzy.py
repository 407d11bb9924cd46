"""Fuzzy title joins by token-set ratio, whole: every pair of titles from ``least`` on, whether or not they share a word.

A title counts as its set of words.  With the common words first and the other words, sorted, behind them, the score of
two titles is the best of three ratios 200 * L / (m + n), L the longest common subsequence.  Two indexes find the pairs:

* *Cover*: the common words alone against one whole title reach ``least`` only if they make up least / (200 - least) of
  its length.  Of a title's words, rarest first, only as many need a lookup as leave too little behind them.
* *Near*: the two whole titles reach ``least`` only if at most d = (1 - least / 100) * (m + n) characters are put in or
  taken out.  The bits of a signature (a hash of each character with its number among its equals, added by exclusive or)
  differ in at most d places then, and those of a signature of neighbouring characters in at most 3 * d.  Word order does
  not matter, nor does a common word.
  Titles of few changes (``FEW``) are dealt by length to groups of at most ``GROUP``, and every two groups of lengths that
  may match meet in a task, which compares signatures bit by bit in arrays and scores what is left.  That takes the square
  of the titles, at a few nanoseconds a pair: with a quarter of the characters free to change, pieces that stay are so
  short that nearly all titles have one in common, and looking them up takes the same square at a far higher price.
  Longer titles are cut into d + 1 pieces inside their words; a change can spoil one piece, so one of them is inside a
  word of the other title.  Pieces are looked up by their first characters and the other title's length.

For longer titles signatures are checked in the join before it makes a row, and that without their common words the titles
are at most d edits apart, as is the length of the common words for the cover.  So what is shuffled after it grows with the real pairs.  Lengths are looked up in classes that widen with them, so
a title has no more keys than a few times its characters.  Between tasks titles are 64-bit hashes.  Lists of more than ``block`` titles are dealt in blocks, so
no list of a frequent word or piece is joined in one task.
"""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

PIECE = 4
BLOCK = 4096
FEW = 24
GROUP = 65_536
TOGETHER = 1024  # titles that a group may hold at least


def word_set(title: Column) -> Column:
    """The distinct words of a title in order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(title, " "), lambda w: w != "")))


def changes(least: float, length: int) -> int:
    """How many characters may be put in or taken out of two titles of this length together."""
    return math.floor((1 - least / 100) * length + 1e-9)


def pieces(words: list[str], count: int) -> list[str]:
    """``count`` pieces inside the words, as long as the shortest of them can be; the empty one if there are too few
    letters, as may be below a score of 80."""
    size = max(len(w) for w in words)
    while sum(len(w) // size for w in words) < count:
        size -= 1
        if not size:
            return [""]
    out = []
    for w in words:
        n = len(w) // size
        out += [w[k * len(w) // n : (k + 1) * len(w) // n] for k in range(n)]
    return sorted(out, key=len, reverse=True)[:count]


def _signature(title):
    """128 bits as two signed numbers."""
    seen, bits = {}, 0
    for c in title:
        k = seen[c] = seen.get(c, 0) + 1
        bits ^= 1 << ((ord(c) * 0x9E3779B1 + k * 0x85EBCA77) % (1 << 32) >> 7) % 128
    low, high = bits & (1 << 64) - 1, bits >> 64
    return low - (low >> 63 << 64), high - (high >> 63 << 64)


def length_class(n: int) -> int:
    """Lengths up to 16 alone, then in classes of about a tenth."""
    return n if n <= 16 else 16 + int(math.log(n / 16, 1.1))


KEYS = "id long, title string, size int, low long, high long, gram string, other int"


def _keyed(keys_of):
    """Rows of a title's id, length and signature and each of its keys, from batches of ids and titles (sorted words,
    joined)."""
    def keyed(batches):
        for batch in batches:
            at, rows = [], ([], [], [], [], [])
            titles = batch.column(1).to_pylist()
            for i, title in enumerate(titles):
                low, high = _signature(title)
                for gram, other in keys_of(title):
                    at.append(i)
                    for column, value in zip(rows, (len(title), low, high, gram, other)):
                        column.append(value)
                if len(at) > 200_000:
                    yield _batch(batch, at, rows)
                    at, rows = [], ([], [], [], [], [])
            yield _batch(batch, at, rows)
    return keyed


def _batch(batch, at, rows):
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32())
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)), *(pa.array(r, k) for r, k in zip(rows, kinds))], names=["id", "title", "size", "low", "high", "gram", "other"])


def _asked(least):
    def keys_of(title):
        words, m, most, cut, out = title.split(" "), len(title), {}, {}, set()
        for n in range(max(1, math.ceil(m * least / (200 - least) - 1e-9)), math.floor(m * (200 - least) / least + 1e-9) + 1):
            most[length_class(n)] = changes(least, m + n)
        for other, d in most.items():
            if d not in cut:
                cut[d] = pieces(words, d + 1)
            out.update((p[:PIECE], other) for p in cut[d])
        return out
    return keys_of


def _held(title):
    words, own = title.split(" "), length_class(len(title))
    return {("", own)} | {(w[k : k + size], own) for w in words for size in range(1, PIECE + 1) for k in range(len(w) - size + 1)}


def _met(asked: DataFrame, held: DataFrame, keys, condition, block: int) -> DataFrame:
    """Pairs (a, b) of equal keys; keys that many of ``held`` have are dealt in blocks."""
    many = held.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > block).select(*keys, F.ceil(F.col("__n") / block).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    left = asked.join(many, keys, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    right = held.join(many, keys, "left").withColumn("block", F.pmod(F.xxhash64("b", F.lit(3)), blocks).cast("int")).drop("blocks")
    return left.join(right, [*keys, "block"]).where(condition).select("a", "b")


def _rest(a: Column, b: Column) -> Column:
    """The words of a title that another lacks."""
    return F.array_join(F.array_except(F.split(a, " "), F.split(b, " ")), " ")


def _signed(batches):
    """Each title's length and its signatures: 128 bits of its characters, 256 of its neighbouring ones."""
    places = {}

    def bits(parts, size, salt):
        seen, out = {}, 0
        for p in parts:
            k = seen[p] = seen.get(p, 0) + 1
            bit = places.get((p, k))
            if bit is None:
                h = (sum(ord(c) * 0x10001 ** i for i, c in enumerate(p)) * 0x9E3779B1 + k * 0x85EBCA77 + salt) % (1 << 32)
                h = (h ^ h >> 15) * 0x2C1B3C6D % (1 << 32)
                bit = 1 << (h >> 9) % size
                if len(places) < 1 << 17:
                    places[p, k] = bit
            out ^= bit
        return out.to_bytes(size // 8, "little")

    for batch in batches:
        for at in range(0, len(batch), 4096):
            part = batch.slice(at, 4096)
            titles = part.column(1).to_pylist()
            padded = [f" {t} " for t in titles]
            signs = b"".join(bits(t, 128, 0) + bits(map("".join, zip(p, p[1:])), 256, 1) for t, p in zip(titles, padded))
            rows = np.frombuffer(signs, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(t) for t in titles], pa.int32()), *(pa.array(rows[:, c]) for c in range(6))], names=["id", "title", "size", *SIGNS])


SIGNS = [f"s{c}" for c in range(6)]
SIGNED = "id long, title string, size int, " + ", ".join(f"{c} long" for c in SIGNS)


def _few(least):
    """The greatest length of titles of which two have at most ``FEW`` changes."""
    return math.floor(FEW / (1 - least / 100) / 2) if least < 100 else 1 << 30


def _groups(sizes: dict, group: int) -> list:
    """(first group, number of groups) of each length, so that a group holds about ``group`` titles: short runs of lengths,
    or slices of one length."""
    out, at, held = {}, 0, 0
    for n in sorted(sizes):
        if sizes[n] > group:
            at, held = at + (held > 0), 0
            out[n] = (at, -(-sizes[n] // group))
            at += out[n][1]
        else:
            if held + sizes[n] > group:
                at, held = at + 1, 0
            out[n], held = (at, 1), held + sizes[n]
    return out


def _spans(groups):
    """The least and greatest length of each group."""
    out = {}
    for n, (first, count) in groups.items():
        for g in range(first, first + count):
            low, high = out.get(g, (n, n))
            out[g] = min(low, n), max(high, n)
    return out


def _common_lengths(left, right):
    """The lengths of the longest common subsequences of pairs of texts, all in bit-parallel steps; -1 where the left one
    has more than 64 characters."""
    out = np.full(len(left), -1)
    pairs = [k for k, x in enumerate(left) if len(x) <= 64]
    if not pairs:
        return out
    wide = [max(1, max(len(t[k]) for k in pairs)) for t in (left, right)]
    x, y = (np.array([t[k] for k in pairs], f"<U{w}").view(np.uint32).reshape(-1, w) for t, w in zip((left, right), wide))
    letters = np.unique(np.concatenate([[0], x.ravel(), y.ravel()]))  # 0 fills short texts up
    rows, (x, y) = np.arange(len(pairs)), (np.searchsorted(letters, t) for t in (x, y))
    places = np.zeros((len(pairs), len(letters)), np.uint64)
    for i in range(wide[0]):
        places[rows, x[:, i]] |= np.uint64(1 << i)
    places[:, 0] = 0
    row = np.full(len(pairs), (1 << 64) - 1, np.uint64)
    for i in range(wide[1]):
        u = row & places[rows, y[:, i]]
        row = (row + u) | (row - u)
    own = np.array([len(left[k]) for k in pairs])
    mask = np.array([(1 << n) - 1 for n in own.tolist()], np.uint64)
    out[pairs] = own - np.bitwise_count(row & mask)
    return out


def _alike(left, right, least):
    """Whether two titles each, whose common words come first, reach ``least`` as wholes."""
    rests, m, n, first = ([], []), [], [], []
    for x, y in zip(left, right):
        v, w = x.split(" "), y.split(" ")
        a, b = set(v), set(w)
        v, w = " ".join([z for z in v if z not in b]), " ".join([z for z in w if z not in a])
        rests[0].append(v)
        rests[1].append(w)
        m.append(len(x))
        n.append(len(y))
        first.append(min(len(x) - len(v), len(y) - len(w)))
    common = _common_lengths(*rests)
    for k in np.flatnonzero(common < 0).tolist():
        common[k] = lcs(rests[0][k], rests[1][k])
    return 200.0 * (np.array(first) + common) >= (least - 1e-6) * (np.array(m) + np.array(n))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, in bit-parallel rows."""
    if not a or not b:
        return 0
    places = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & places.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _pairs(least, once):
    """Pairs (a, b) of two groups of titles that reach ``least`` as wholes."""
    share = 1 - least / 100

    def pairs(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        right = right.sort_by("size").combine_chunks()
        ids, sizes = ([t[c].to_numpy() for t in (left, right)] for c in ("id", "size"))
        signs = [np.stack([t[c].to_numpy().view(np.uint64) for c in SIGNS]) for t in (left, right)]
        folded = [s[0] ^ s[1] for s in signs]
        same = once and key[0].as_py() == key[1].as_py()
        found, held, n_held = ([], []), ([], []), 0

        def keep():
            i, j = (np.concatenate(h) for h in held)
            d = np.floor(share * (sizes[0][i] + sizes[1][j]) + 1e-9)
            for rows, times in (((0, 1), 1), ((2, 3, 4, 5), 3)):
                apart = sum(np.bitwise_count(signs[0][c, i] ^ signs[1][c, j]).astype(np.int16) for c in rows)
                k = apart <= times * d
                i, j, d = i[k], j[k], d[k]
            if same:
                k = ids[0][i] <= ids[1][j]
                i, j = i[k], j[k]
            for at in range(0, len(i), 50_000):
                some = slice(at, at + 50_000)
                k = _alike(*(t["title"].take(pa.array(r[some])).to_pylist() for t, r in ((left, i), (right, j))), least)
                found[0].append(ids[0][i[some][k]])
                found[1].append(ids[1][j[some][k]])
            held[0].clear()
            held[1].clear()

        for at in range(0, len(right), 8192):
            part, most = folded[1][at : at + 8192], int(sizes[1][at : at + 8192].max())
            apart, bits, near = np.empty_like(part), np.empty(len(part), np.uint8), np.empty(len(part), bool)
            for i, (own, d) in enumerate(zip(folded[0], np.floor(share * (sizes[0] + most) + 1e-9).astype(np.uint8))):
                np.bitwise_xor(part, own, out=apart)
                np.bitwise_count(apart, out=bits)
                np.less_equal(bits, d, out=near)
                j = near.nonzero()[0]
                if len(j):
                    held[0].append(np.full(len(j), i))
                    held[1].append(j + at)
                    n_held += len(j)
                    if n_held > 500_000:
                        keep()
                        n_held = 0
        if n_held:
            keep()
        return pa.table([pa.array(np.concatenate(f or [np.zeros(0, np.int64)])) for f in found], names=["a", "b"])
    return pairs


def _compared(a: DataFrame, b: DataFrame, least: float, once: bool, group: int) -> DataFrame:
    """Near pairs (a, b) of titles of few changes: every two groups of lengths that may match meet in a task."""
    spark, longest = a.sparkSession, _few(least)
    counts = [{r["n"]: r["c"] for r in t.groupBy(F.length("title").alias("n")).agg(F.count("*").alias("c")).where(F.col("n") <= longest).collect()} for t in ((a,) if once else (a, b))]
    groups = [_groups(c, max(TOGETHER, min(group, -(-sum(c.values()) // 16)))) for c in counts] * (2 if once else 1)
    spans = [_spans(g) for g in groups]
    met = [(p, q) for p, (m, upto) in spans[0].items() for q, (n, to) in spans[1].items() if (p <= q or not once) and max(n - upto, m - to, 0) <= changes(least, upto + to)]
    if not met:
        return spark.createDataFrame([], "a long, b long")
    sides = []
    for k, df in enumerate((a, b)):
        partners = {}
        for pair in met:
            partners.setdefault(pair[k], []).append(pair[1 - k])
        rows = [(n, first, count) for n, (first, count) in groups[k].items()]
        lengths = F.broadcast(spark.createDataFrame(rows, "size int, first int, count int"))
        others = F.broadcast(spark.createDataFrame(list(partners.items()), "own int, others array<int>"))
        signed = df.where(F.length("title") <= longest).mapInArrow(_signed, SIGNED).join(lengths, "size")
        signed = signed.withColumn("own", F.col("first") + F.pmod(F.xxhash64("id", F.lit(5)), F.col("count")).cast("int")).join(others, "own")
        signed = signed.select("id", "title", "size", *SIGNS, "own", F.explode("others").alias("other"))
        signed = signed.withColumnsRenamed({"own": "pq"[k], "other": "pq"[1 - k]})
        sides.append(signed.repartition(min(len(met), 4096), "p", "q").groupBy("p", "q"))
    return sides[0].cogroup(sides[1]).applyInArrow(_pairs(least, once), "a long, b long")


def _near(a: DataFrame, b: DataFrame, least: float, block: int, once: bool = False, group: int = GROUP) -> DataFrame:
    """Near pairs: those of titles of few changes by comparison, those with a longer one by pieces."""
    longest = _few(least)
    beside = math.floor(longest * least / (200 - least) + 1e-9)  # no shorter one is near to a longer one
    long = lambda t: t.where(F.length("title") >= beside)
    return _compared(a, b, least, once, group).unionAll(_by_pieces(long(a), long(b), least, block, (F.col("m") > longest) | (F.col("n") > longest), once))


def _by_pieces(a: DataFrame, b: DataFrame, least: float, block: int, wanted: Column, once: bool) -> DataFrame:
    """Near pairs of a ``wanted`` length, met by their pieces."""
    left = a.mapInArrow(_keyed(_asked(least)), KEYS).toDF("a", "x", "m", "low", "high", "gram", "class")
    right = b.mapInArrow(_keyed(_held), KEYS).toDF("b", "y", "n", "low2", "high2", "gram", "class")
    apart = F.bit_count(F.col("low").bitwiseXOR(F.col("low2"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("high2")))
    d = F.lit(1 - least / 100) * (F.col("m") + F.col("n")) + 1e-9
    edits = F.call_function("levenshtein", _rest(F.col("x"), F.col("y")), _rest(F.col("y"), F.col("x")), d.cast("int"))  # -1 beyond
    condition = wanted & (apart <= d) & (F.abs(F.col("m") - F.col("n")) <= d) & (edits >= 0)
    return _met(left, right, ["gram", "class"], (F.col("a") <= F.col("b")) & condition if once else condition, block)


def _cover(a: DataFrame, b: DataFrame, least: float, block: int) -> DataFrame:
    """Pairs in which the common words make up enough of ``a``."""
    words = lambda df, name, size, title: df.select(F.col("id").alias(name), F.col("title").alias(title), F.length("title").alias(size), F.explode(F.split("title", " ")).alias("word"))
    held = words(b, "b", "n", "y")
    frequency = held.groupBy("word").agg(F.count("*").alias("f"))
    need = F.lit(least / (200 - least)) * F.col("m") - 1e-9
    behind = F.sum(F.length("word") + 1).over(Window.partitionBy("a").orderBy(F.coalesce("f", F.lit(0)).desc(), F.desc("word")))
    asked = words(a, "a", "m", "x").join(frequency, "word", "left").withColumn("behind", behind).where((F.col("behind") - 1 >= need) & F.col("f").isNotNull())
    common = F.length(F.array_join(F.array_intersect(F.split("x", " "), F.split("y", " ")), " "))
    return _met(asked.select("a", "x", "word", need.alias("need")), held, ["word"], (F.col("n") >= F.col("need")) & (common >= F.col("need")), block)


def similar_titles(left: DataFrame, right: DataFrame, a: str, b: str, least: float, block: int = BLOCK, once: bool = False) -> DataFrame:
    """(a, b, score): all pairs of distinct titles of the two columns whose token-set ratio is ``least`` or more.
    Titles are words parted by single spaces, as ``normal_title`` gives them; null and empty ones have no pairs.

    Titles of equal word sets are compared once.  Below 80 very short titles are compared with all of a length.
    ``once`` is for a table with itself: a pair is scored and told in one direction."""
    if not 50 <= least <= 100:
        raise ValueError("least must be from 50 to 100")
    from .linkage import token_set_ratio
    def named(df, title):
        joined = F.array_join(word_set(F.col(title)), " ")
        return df.select(F.col(title).alias("said"), joined.alias("title"), F.xxhash64(joined).alias("id")).where(F.col("title") != "").distinct()

    x, y = named(left, a), named(right, b)
    xs = cut(x.select("id", "title").distinct())
    ys = xs if once else cut(y.select("id", "title").distinct())
    pairs = _near(xs, ys, least, block, once).unionAll(_cover(xs, ys, least, block))
    if once:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    else:
        pairs = pairs.unionAll(_cover(ys, xs, least, block).select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    full = pairs.join(xs.toDF("a", "x"), "a").join(ys.toDF("b", "y"), "b")
    scored = full.select("a", "b", token_set_ratio("x", "y").alias("score")).where(F.col("score") >= least)
    said = scored.join(x.select(F.col("id").alias("a"), F.col("said").alias("l")), "a").join(y.select(F.col("id").alias("b"), F.col("said").alias("r")), "b")
    return said.select(F.col("l").alias("a"), F.col("r").alias("b"), "score")
