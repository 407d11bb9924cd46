"""N-gram Jaccard join with token-combination prefixes.

A document's tokens are its distinct shingles of ``width`` words (the whole sequence, if it has fewer words).  Tokens
have one global order: rare ones by hash, then frequent ones by hash.  Of a set that may miss m tokens of a similar
one, the prefix takes tokens until (rare) + max(0, frequent - 1) exceeds m; rare tokens are indexed alone, frequent ones
in pairs.  Two similar sets then share an index entry: of the tokens that both prefixes could share, at most m are
missing.  Sets above ``LARGE`` tokens index frequent tokens alone too, since they would have too many pairs; those near
that size are indexed either way.  Frequent tokens only steer which entries there are, never the result.  The pairs of
a prefix that begin with the same token are one row: the token, and the array of second tokens.

Equal sets are one set (its 64-bit id is the sum of mixed token hashes); they are linked without comparing.  The sets
that meet at an entry are compared by bitmaps (parity of hashed tokens, a lower bound of the difference): 512 bits, and
at least four bits a token where more than ``BLOCK`` // 32 sets meet.  Within a list, pairs that the bitmaps don't rule
out join their sets tentatively, and only pairs that join two groups leave the list, so that it emits fewer pairs than it
has sets.  The pairs are verified on whole texts.  A list all of whose pairs hold is settled: every pair across its groups
was ruled out.  The lists with a refuted pair are gone through again, with what is known by then: there a group is joined
to another by one pair in the first round, by 64 in the second, by 4,096 in the third, and in a fourth all pairs of the
lists that are left are verified.  No link between components
is lost, and neither copies nor near misses cost all pairs.  A list of more than ``BLOCK`` sets is cut into blocks, each
pair of which is a task's work of its own.

The links that are returned span the components; links between sets that are connected already need not be among them.

Null, empty and wordless texts have no tokens and are linked with nothing.  Repeated ids are told apart by nothing:
each row has its own set, and a component's id is the smallest id among its rows (null ids are not counted).  An empty
table gives an empty result.  Only the id and text columns are read.
"""
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from .arrays import Rolling, is_space, lean, lower_table, mix, text_slices, word_bounds
from .components import components
from .store import discard, stored

LARGE = 640
FREQUENT, FREQUENT_LOCAL, FREQUENT_TOKENS = 32, 4, 200_000
HELD_TOKENS = 2_000_000
BITMAP_WORDS = 8
BLOCK = 1024
LIMITS = [1, 64, 4096, None]
PASSES = 4
FILTER_BITS = 1 << 24
U = np.uint64
MULTIPLIERS = [U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)]


class Shingler:
    """Sorted distinct token hashes of each text of a batch."""

    def __init__(self, width):
        self.width, self.rolling, self.wordly, self.lower = width, Rolling(), ~is_space_table(), lower_table()

    def __call__(self, buf, offsets):
        buf = self.lower[buf]
        starts, ends, first = word_bounds(buf, offsets, self.wordly)
        words = self.rolling.spans(self.rolling.prefix(buf), starts, ends) if len(starts) else np.empty(0, U)
        n, w = len(words), self.width
        grams = np.zeros(max(n - w + 1, 0), dtype=U)
        for k in range(w):
            grams += words[k : n - w + 1 + k] * MULTIPLIERS[k % 6] ** U(1 + k // 6) if n >= w else U(0)
        grams = mix(grams)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= w:
                yield np.unique(grams[a : b - w + 1])
            elif b > a:
                h = np.array([b - a], dtype=U)
                for k in range(a, b):
                    h = mix(h * MULTIPLIERS[0] + words[k : k + 1])
                yield h
            else:
                yield np.empty(0, U)


def is_space_table():
    return ~is_space()


def set_id(tokens):
    return int(mix(tokens ^ U(0x5851F42D4C957F2D)).sum(dtype=U).astype(np.int64)) if len(tokens) else 0


def bitmap(tokens):
    """Parities of at least four bits a token, a power of two in all, so that one can be folded to another's size."""
    bits = 64 * BITMAP_WORDS
    while bits < 4 * len(tokens):
        bits *= 2
    return np.packbits((np.bincount((tokens & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def short_bytes(n, percent):
    """Bytes of a bitmap that rules out unrelated sets of about n tokens: half its bits will differ."""
    size = 8 * BITMAP_WORDS
    while 8 * size * (100 + percent) < 5 * n * (100 - percent):
        size *= 2
    return size


def folded(bits, size):
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def wide_differs(a, b):
    a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


PROFILE_TYPE = "id {}, sid long, size long, bitmap binary, wide binary, token long, count long"


def _profiles(width, percent):
    def profiles(batches):
        shingles = Shingler(width)
        seen, held, size = set(), [], 0

        def frequent(batch):
            nonlocal held, size
            if held:
                tokens, counts = np.unique(np.concatenate(held), return_counts=True)
                tokens, counts = tokens[counts >= FREQUENT_LOCAL].view(np.int64), counts[counts >= FREQUENT_LOCAL]
                n = len(tokens)
                held, size = [], 0
                return pa.RecordBatch.from_arrays([pa.nulls(n, batch.schema[0].type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(tokens), pa.array(counts)], names=["id", "sid", "size", "bitmap", "wide", "token", "count"])
            return None

        for batch in batches:
            for a, b, buf, offsets in text_slices(batch.column(1)):
                sids, sizes, maps, wides = [], [], [], []
                for tokens in shingles(buf, offsets):
                    sid = set_id(tokens)
                    sids.append(sid)
                    sizes.append(len(tokens))
                    bits = bitmap(tokens)
                    maps.append(folded(bits, short_bytes(len(tokens), percent)).tobytes())
                    wides.append(bits.tobytes())
                    if sid not in seen:
                        seen.add(sid)
                        held.append(tokens)
                        size += len(tokens)
                n = b - a
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary()), pa.array(wides, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=["id", "sid", "size", "bitmap", "wide", "token", "count"])
                if size > HELD_TOKENS:
                    yield frequent(batch)
                    seen.clear()
        if held:
            yield frequent(batch)
    return profiles


def prefix_entries(tokens, frequent, missing, paired):
    """(entries of single tokens, first tokens of pairs, all pairs' second tokens, their bounds by first token) of a
    sorted token array; ``frequent``: mask; ``missing``: tokens a similar set may lack."""
    none = np.empty(0, dtype=U)
    if not paired:
        order = np.concatenate([tokens[~frequent], tokens[frequent]])
        return mix(order[: missing + 1] * MULTIPLIERS[2] + U(1)), none, []
    rare, common = tokens[~frequent], tokens[frequent]
    single = mix(rare[: missing + 1] * MULTIPLIERS[2] + U(2))
    if len(rare) > missing or not len(common):
        return single, none, []
    common = common[: missing + 2 - len(rare)]  # rare + (frequent - 1) must exceed the missing ones
    return single, mix(common[:-1] * MULTIPLIERS[3] + U(3)), [common[k + 1 :] for k in range(len(common) - 1)]


def entries(tokens, frequent, percent):
    """Where a set meets others: entries of single tokens, first tokens of pairs, and the second tokens of each."""
    n = len(tokens)
    missing = n - -(-percent * n // 100)
    single, homes, seconds = [], np.empty(0, dtype=U), []
    pairable = missing + 2 <= n
    if n <= 100 * LARGE // percent and pairable:
        keys, homes, seconds = prefix_entries(tokens, frequent, missing, True)
        single.append(keys)
    if n * 100 >= percent * LARGE or not pairable or n <= tiny(percent):
        single.append(prefix_entries(tokens, frequent, missing, False)[0])
    return np.unique(np.concatenate(single)), homes, seconds


def tiny(percent):
    """Sizes up to which a similar set may be one that has no token to spare for pairs."""
    return 100 * 2 // percent + 1


POSTING_TYPE = "meet long, sid long, size long, seconds array<long>"


def _postings(width, percent, common):
    def postings(batches):
        shingles, known, seen = Shingler(width), common.value, set()
        for batch in batches:
            for a, b, buf, offsets in text_slices(batch.column(0)):
                keys, sids, lengths, sizes, lists, counts = [], [], [], [], [], []
                for tokens in shingles(buf, offsets):
                    sid = set_id(tokens)
                    if not len(tokens) or sid in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(sid)
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    single, homes, seconds = entries(tokens, known[at] == tokens, percent)
                    keys += [single, homes]
                    sids.append(sid)
                    lengths.append(len(tokens))
                    sizes.append(len(single) + len(homes))
                    lists += seconds
                    counts += [0] * len(single) + [len(s) for s in seconds]
                if keys:
                    counts = np.array(counts, dtype=np.int64)
                    arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(np.concatenate([np.empty(0, U), *lists]).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.repeat(np.array(x, np.int64), sizes)) for x in (sids, lengths)), arrays], names=["meet", "sid", "size", "seconds"])
    return postings


def short_maps(column):
    """(n, words) array of a binary column of bitmaps, all folded to the shortest size."""
    n, size = len(column), 8 * BITMAP_WORDS
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data, lengths, out = np.frombuffer(data, np.uint8), np.diff(offsets), np.empty((n, size), np.uint8)
    for length in np.unique(lengths).tolist():
        here = np.flatnonzero(lengths == length)
        bits = data[offsets[here][:, None] + np.arange(length)]
        while bits.shape[1] > size:
            bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
        out[here] = bits
    return out.view(U)


class Meeting:
    """The sets that meet at one entry, in the order of their sizes, and the pairs that leave it."""

    def __init__(self, percent, sid, size, maps, component, block, refuted, limit):
        order = np.lexsort((sid, size))
        self.percent, self.limit = percent, limit
        self.sid, self.size, self.block = sid[order], size[order], block[order]
        self.group = np.unique(component[order], return_inverse=True)[1]
        self.maps = [np.frombuffer(maps[i], np.uint8) for i in order.tolist()]
        self.short = np.stack([folded(m, 8 * BITMAP_WORDS) for m in self.maps]).view(U)
        self.wide = max(map(len, self.maps)) > 8 * BITMAP_WORDS
        self.refuted = [refuted[i] for i in order.tolist()]
        self.cross = bool((self.block != self.block[0]).any())
        self.out, self.emitted = [], {}

    def bound(self, i, js):
        return (self.size[js] + self.size[i]) * (100 - self.percent)

    def settle(self, members=None):
        """Compares all pairs of the members (all sets by default) of different groups."""
        at = np.arange(len(self.sid)) if members is None else members
        size, short = self.size[at], self.short[at]
        end = np.searchsorted(size * self.percent, size * 100, side="right")  # sets behind it are too large
        rows = max(1, 200_000 // len(at))
        for a in range(0, len(at) - 1, rows):
            b = min(a + rows, len(at))
            hi = int(end[b - 1])
            if (self.group[at[a:hi]] == self.group[at[a]]).all():
                continue
            differs = np.zeros((b - a, hi - a), dtype=np.uint16)
            for k in range(BITMAP_WORDS):
                differs += np.bitwise_count(short[a:b, None, k] ^ short[None, a:hi, k])
            near = differs.astype(np.int64) * (100 + self.percent) <= (size[a:b, None] + size[None, a:hi]) * (100 - self.percent)
            for i in range(a, b):
                js = at[i + 1 : end[i]][near[i - a, i + 1 - a : end[i] - a]]
                if len(js):
                    self._join(int(at[i]), js)

    def _join(self, i, js):
        js = js[self.group[js] != self.group[i]]
        if self.cross:
            js = js[self.block[js] != self.block[i]]
        if len(js) and self.refuted[i]:
            js = js[~np.isin(self.sid[js], self.refuted[i])]
        for j in js.tolist():
            one, two = int(self.group[i]), int(self.group[j])
            if one == two or self.wide and wide_differs(self.maps[i], self.maps[j]) * (100 + self.percent) > self.bound(i, j):
                continue
            self.out.append((int(self.sid[i]), int(self.sid[j])))
            for group in (one, two):
                self.emitted[group] = self.emitted.get(group, 0) + 1
            if self.limit and max(self.emitted[one], self.emitted[two]) >= self.limit:
                self.group[self.group == two] = one
                self.emitted[one] = 0


LIST_COLUMNS = ["meet", "one", "two", "sid", "size", "component", "block", "map", "seconds", "refuted"]


def _lists(percent, limit):
    """Candidate pairs of meetings, streamed in the order of (meet, one, two)."""
    def pairs_of(rows):
        sid, size, component, block = (rows.column(k).to_numpy() for k in range(3, 7))
        if len(sid) < 2 or (component == component[0]).all():
            return []
        meeting = Meeting(percent, sid, size, rows.column(7).to_pylist(), component, block, rows.column(8 + 1).to_pylist(), limit)
        seconds = rows.column(8)
        counts = pc.list_value_length(seconds).fill_null(0).to_numpy()
        total = int(counts.sum())
        if not total:
            meeting.settle()
            return meeting.out
        # Pairs of tokens: by the lists of equal second tokens, unless all pairs are fewer.
        owner = np.repeat(np.argsort(np.lexsort((sid, size))), counts)
        tokens = seconds.flatten().to_numpy()
        order = np.lexsort((owner, tokens))
        owner, tokens = owner[order], tokens[order]
        edge = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
        lengths = np.diff(edge)
        if (lengths[lengths > 1] ** 2).sum() * 2 > len(sid) ** 2:
            meeting.settle()
        else:
            for a, n in zip(edge[:-1][lengths > 1].tolist(), lengths[lengths > 1].tolist()):
                meeting.settle(owner[a : a + n])
        return meeting.out

    def open_lists(rows, begin, end, ruled):
        """Of short lists, those with a pair that bitmaps don't rule out."""
        sid, size, component = (rows.column(k).to_numpy() for k in range(3, 6))
        short, maps = short_maps(rows.column(7)), rows.column(7)
        stop = np.zeros(len(sid), dtype=np.int64)
        name = np.full(len(sid), -1, dtype=np.int64)
        for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
            stop[a:b], name[a:b] = b, k
        at, open_ = np.flatnonzero(name >= 0), set()
        for step in range(1, int((end - begin).max(initial=0))):
            at = at[at + step < stop[at]]
            i, j = at, at + step
            differs = np.zeros(len(i), dtype=np.int64)
            for k in range(BITMAP_WORDS):
                differs += np.bitwise_count(short[i, k] ^ short[j, k])
            total = size[i] + size[j]
            near = (differs * (100 + percent) <= total * (100 - percent)) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])) & (component[i] != component[j])
            for x, y, list_, n in zip(i[near].tolist(), j[near].tolist(), name[i[near]].tolist(), total[near].tolist()):
                pair = (int(sid[x]), int(sid[y]))
                if list_ in open_ or pair in ruled:
                    continue
                if wide_differs(maps[x].as_py(), maps[y].as_py()) * (100 + percent) > n * (100 - percent):
                    if len(ruled) >= 1_000_000:
                        ruled.clear()
                    ruled.add(pair)
                else:
                    open_.add(list_)
        return sorted(open_)

    def lists(batches):
        ruled, out = set(), []

        def settle(rows, begin, end):
            few = end - begin <= BLOCK // 32
            todo = list(zip(begin[~few].tolist(), end[~few].tolist()))
            todo += [(int(begin[few][k]), int(end[few][k])) for k in open_lists(rows, begin[few], end[few], ruled)]
            for a, b in todo:
                key = [rows.column(k)[a].as_py() for k in range(3)]
                out.extend((*pair, *key) for pair in pairs_of(rows.slice(a, b - a)))

        def flushed():
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            done = pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], t) for k, t in enumerate(types)], names=["a", "b", "meet", "one", "two"])
            out.clear()
            return done

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            key = [rest.column(k).to_numpy() for k in range(3)]
            edge = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in key])) + 1
            if not len(edge):
                continue
            whole, rest = rest.slice(0, int(edge[-1])).combine_chunks(), rest.slice(int(edge[-1])).combine_chunks()
            settle(whole.to_batches()[0], np.concatenate([[0], edge[:-1]]), edge)
            if len(out) > 50_000:
                yield flushed()
        if rest is not None:
            settle(rest.combine_chunks().to_batches()[0], np.array([0]), np.array([rest.num_rows]))
        yield flushed()
    return lists


def _refine(percent):
    """Pairs that the wide bitmaps don't rule out."""
    def refine(batches):
        for batch in batches:
            keep = [wide_differs(x, y) * (100 + percent) <= (m + n) * (100 - percent) for m, n, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return refine


def _wanted(width, bits):
    """Texts whose id the filter lets through: (sid, packed text)."""
    def wanted(batches):
        import zstandard
        shingles, table, pack = Shingler(width), bits.value, zstandard.ZstdCompressor(3)
        for batch in batches:
            slot = batch.column(1).to_numpy()
            batch = batch.filter(pa.array((table[slot >> 6] >> (slot & 63)) & 1 == 1))
            for a, b, buf, offsets in text_slices(batch.column(0)):
                sids = [set_id(t) for t in shingles(buf, offsets)]
                data, at = buf.tobytes(), offsets.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array([pack.compress(data[x:y]) for x, y in zip(at, at[1:])], pa.binary())], names=["sid", "packed"])
    return wanted


def _verify(width, percent):
    def verify(batches):
        import zstandard
        shingles, unpack = Shingler(width), zstandard.ZstdDecompressor()

        def tokens(packed):
            data = np.frombuffer(unpack.decompress(packed), dtype=np.uint8)
            return next(shingles(data, np.array([0, len(data)])))

        last = None
        for batch in batches:
            out = []
            for a, b, pa_, pb in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if last is None or last[0] != a:
                    last = (a, tokens(pa_))
                x, y = last[1], tokens(pb)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out.append((a, b, common, len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(4)], names=["a", "b", "shared", "total"])
    return verify


def slot(column, bits=FILTER_BITS):
    return F.pmod(F.xxhash64(column), F.lit(bits))


def verified(docs, pairs, profiles, width, percent):
    """Links (a, b, shared, total) among candidate pairs of set ids; ``docs``: id, text."""
    spark = docs.sparkSession
    first = profiles.groupBy("sid").agg(F.min("id").alias("id"))
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(first, "sid"), "wanted")
    # A filter of fixed size spares most other texts the shuffle; when it fills up, more of them pass and nothing is lost.
    words = ids.select(slot("id").alias("s")).distinct().groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits"))
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in words.collect():
        table[r["w"]] = r["bits"]
    source = docs.select("text", slot("id").alias("slot"), "id")
    texts = source.select("text", "slot").mapInArrow(lean(_wanted(width, spark.sparkContext.broadcast(table))), "sid long, packed binary")
    texts = stored(texts.join(ids.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.min("packed").alias("packed")), "texts")
    both = pairs.join(texts.select(F.col("sid").alias("b"), F.col("packed").alias("pb")), "b").join(texts.select(F.col("sid").alias("a"), F.col("packed").alias("pa")), "a")
    links = stored(both.select("a", "b", "pa", "pb").sortWithinPartitions("a").mapInArrow(lean(_verify(width, percent)), "a long, b long, shared long, total long"), "links")
    discard(texts, ids)
    return links


def meetings(docs, tokens, width, percent):
    """Stored tables (meet, sid, size, n, seconds): the sets that meet others, with the number of rows of their entry.

    There is one for each of ``PASSES`` shares of the entries: the shuffles of one share at a time lie on disk."""
    spark = docs.sparkSession
    postings = stored(docs.select("text").mapInArrow(lean(_postings(width, percent, spark.sparkContext.broadcast(tokens))), POSTING_TYPE), "postings")
    over = Window.partitionBy("meet")
    before, after = (f("size").over(over.orderBy("size")) for f in (F.lag, F.lead))
    pairs = postings.where(F.size("seconds") > 0)
    # First tokens of pairs are among the FREQUENT_TOKENS that the driver holds, and so are their counts.
    homes = F.broadcast(pairs.groupBy("meet").agg(F.count("*").alias("n"), F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("meet", "n"))
    columns = ["meet", "sid", "size", "n"]
    shared = pairs.join(homes, "meet").select(*columns, "seconds")
    # Of an entry's sets, those whose size has no near one go before anything else is read.
    alike = postings.where(F.size("seconds") <= 0).select("meet", "sid", "size").withColumns({"before": before, "after": after}).where(F.expr(f"100 * before >= {percent} * size or 100 * size >= {percent} * after"))
    single = alike.withColumns({"n": F.count("*").over(over), "lo": F.min("sid").over(over), "hi": F.max("sid").over(over)}).where("lo <> hi")
    shared = shared.unionAll(single.select(*columns, F.lit(None).cast("array<long>").alias("seconds")))
    parts = [stored(shared.where(F.pmod("meet", F.lit(PASSES)) == k).dropDuplicates(["sid", "meet"]), "meetings") for k in range(PASSES)]
    discard(postings)
    return parts


def dealt(shared, profiles):
    """The rows of meetings with their bitmaps (``map``), dealt to pairs of blocks (one, two) where an entry has many."""
    maps = profiles.where("size > 0").groupBy("sid").agg(F.min("bitmap").alias("bitmap"), F.min("wide").alias("wide"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    rows = shared.join(maps, "sid").withColumns({"blocks": blocks, "block": own, "map": F.when(F.col("n") > BLOCK // 32, F.col("wide")).otherwise(F.col("bitmap"))})
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})


def join(docs, doc_id="doc_id", text="text", width=3, percent=90):
    """(profiles, links, labels): per row id, sid and size; verified links between sets that span the components;
    (node, root) of linked sets."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    made = stored(docs.mapInArrow(lean(_profiles(width, percent)), PROFILE_TYPE.format(kind)), "profiles")
    profiles = made.where(F.col("sid").isNotNull()).select("id", "sid", "size", "bitmap", "wide")
    common = made.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("count").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(FREQUENT_TOKENS)
    tokens = np.sort(np.array([r[0] for r in common.select("token").collect()] or [0], dtype=np.int64).view(U))
    parts = meetings(docs, tokens, width, percent)
    shared = functools.reduce(lambda a, b: a.unionAll(b), parts)
    wide = profiles.where("size > 0").groupBy("sid").agg(F.first("size").alias("size"), F.min("wide").alias("wide"))
    left, right = (wide.select(F.col("sid").alias(k), F.col("size").alias(f"n{k}"), F.col("wide").alias(f"w{k}")) for k in "ab")

    def candidates(rows, limit):
        order = rows.select(*LIST_COLUMNS).repartition("meet", "one", "two").sortWithinPartitions("meet", "one", "two", "sid")
        return stored(order.mapInArrow(lean(_lists(percent, limit)), "a long, b long, meet long, one int, two int"), "pairs")

    rounds = [dealt(part, profiles).withColumns({"component": F.col("sid"), "refuted": F.lit(None).cast("array<long>")}) for part in parts]
    links, tried = None, None
    for limit in LIMITS:
        tables = [candidates(rows, limit) for rows in rounds]
        listed = functools.reduce(lambda a, b: a.unionAll(b), tables)
        pairs = stored(listed.select("a", "b").distinct(), "distinct")
        near = stored(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "wa", "wb").mapInArrow(lean(_refine(percent)), "a long, b long"), "near")
        found = verified(docs, near, profiles, width, percent)
        links = found if links is None else links.unionAll(found)
        labels = components(links)
        roots = [labels.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in "ab"]
        wrong = pairs.join(found, ["a", "b"], "left_anti").join(roots[0], "a", "left").join(roots[1], "b", "left")
        wrong = stored(wrong.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "refuted")
        discard(pairs, near)
        if limit is None or wrong.isEmpty():
            discard(*parts, *tables)
            return profiles, links, labels
        # The meetings that a refuted pair came from, with the components and the refuted pairs of their sets.
        tried = wrong if tried is None else tried.unionAll(wrong)
        again = stored(listed.join(wrong, ["a", "b"], "left_semi").select("meet", "one", "two").distinct(), "again")
        discard(*tables)
        known = tried.select(F.col("a").alias("sid"), F.col("b").alias("no")).unionAll(tried.select(F.col("b").alias("sid"), F.col("a").alias("no"))).groupBy("sid").agg(F.collect_set("no").alias("refuted"))
        here = shared.join(again.select("meet").distinct(), "meet", "left_semi")
        rounds = [dealt(here, profiles).join(again, ["meet", "one", "two"], "left_semi").join(labels.select(F.col("node").alias("sid"), "root"), "sid", "left").join(known, "sid", "left").withColumn("component", F.coalesce("root", "sid"))]


def classes(docs, doc_id="doc_id", text="text", width=3, percent=90):
    """One row per document: id, n_shingles, sid (set), component (root set), component_id (smallest id)."""
    profiles, links, labels = join(docs, doc_id, text, width, percent)
    sets = profiles.where("size > 0").groupBy("sid").agg(F.min("id").alias("first")).join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "first", F.coalesce("root", "sid").alias("component"))
    sets = stored(sets, "sets")
    roots = sets.groupBy("component").agg(F.min("first").alias("component_id"))
    known = sets.join(roots, "component").select("sid", "component", "component_id")
    joined = profiles.join(known, "sid", "left")
    own = F.col("size") == 0
    return joined.select("id", F.col("size").alias("n_shingles"), "sid", "component", F.when(own, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs, doc_id="doc_id", text="text", width=5, percent=80):
    """The documents without those that have a near copy with a smaller id in their component; all columns stay.

    Of rows with equal ids in one component all stay or go together, but of equal rows (ids and texts) one stays.
    Documents without words stay."""
    made = stored(classes(docs, doc_id, text, width, percent).where("n_shingles > 0").select("id", "sid", "component_id"), "classes")
    gone = made.where("id <> component_id or id is null").select(F.col("id").alias("__id")).distinct()
    kept = docs.join(gone, F.col(doc_id) == F.col("__id"), "left_anti")
    twice = made.groupBy("id").count().where("count > 1")
    if twice.isEmpty():
        return kept
    repeated = kept.join(twice.select(F.col("id").alias("__id")), F.col(doc_id) == F.col("__id"), "left_semi").dropDuplicates([doc_id, text])
    return kept.join(twice.select(F.col("id").alias("__id")), F.col(doc_id) == F.col("__id"), "left_anti").unionAll(repeated)


def op3_ngram_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
