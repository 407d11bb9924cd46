"""Benchmark decontamination: a generalised suffix automaton of the benchmark, streamed over documents.

Words are runs of ASCII letters (folded to lower case), digits and non-ASCII characters.  A window is
``window`` consecutive words of one item; an item of fewer words, but not none, is one window.  Words of
a document inside an occurrence of a window are hit.

Null, empty and wordless texts have no words and no hits; null or wordless items make no windows; equal
items all count.  Repeated documents are each judged alone.  With no items nothing is hit.  Only the id
and text columns are read by ``scan``; ``decontaminate`` carries every other column through unchanged.
Items travel to the executors in blocks of at most ``block_words`` words, which bounds what is broadcast;
documents are streamed once for each block.  With several blocks the documents are stored with a row number,
every block is looked for in the whole text, and a row's spans are united before they are judged and cut, so
that results don't depend on ``block_words``.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import Rolling, is_alnum, lean, lower_table, text_slices, word_bounds
from .store import stored

WINDOW = 10
BLOCK_WORDS = 100_000
SCAN_TYPE = "id string, n_words long, spans array<struct<first:int,last:int,start:int,end:int>>, items array<string>"


def item_words(text):
    data = (text or "").encode().translate(bytes(lower_table()))
    buf = np.frombuffer(data, dtype=np.uint8)
    starts, ends, _ = word_bounds(buf, np.array([0, len(buf)]), is_alnum())
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


class Automaton:
    """Suffix automaton of many word sequences.

    ``step`` keeps the state of the longest suffix of the stream that occurs in an item, and its length.
    """

    def __init__(self, items, window):
        self.window = window
        self.vocabulary = {}
        self.next, self.link, self.length = [{}], [-1], [0]
        ends = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            last = 0
            for c in ids:
                last = self._extend(last, c)
            ends.append((name, ids, last))
        self._items(ends)

    def _extend(self, last, c):
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p, c, q):
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def _items(self, ends):
        """Items of each window state, and the short items that end at a state."""
        self.window_items, self.short_at = {}, {}
        self.short = []
        for name, ids, _ in ends:
            state = n = 0
            for c in ids:
                state, n = self.step(state, n, c)
                if n >= self.window:
                    self.window_items.setdefault(self.window_state(state), set()).add(name)
            if len(ids) < self.window:
                self.short_at.setdefault(state, []).append((len(ids), name))
                self.short.append(ids)
        self._short_of = {}

    def window_state(self, state):
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def short_of(self, state):
        """(length, item) of the short items that are suffixes of a state's strings."""
        got = self._short_of.get(state)
        if got is None:
            got, at = [], state
            while at > 0:
                got += self.short_at.get(at, ())
                at = self.link[at]
            self._short_of[state] = got
        return got

    def step(self, state, n, c):
        while state and c not in self.next[state]:
            state = self.link[state]
            n = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], n + 1
        return 0, 0


class Matcher:
    """Streams batches of texts through the automaton.

    Stretches in which two neighbouring words are never neighbours in an item, or that are shorter than any
    window, cannot hold a window; they are found on whole arrays of word hashes and not stepped through.
    """

    def __init__(self, items, window=WINDOW):
        self.automaton = Automaton(items, window)
        self.rolling = Rolling()
        self.window = window
        self.wordly, self.lower = is_alnum(), lower_table()
        words = list(self.automaton.vocabulary)
        joined = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.empty(0, np.int64)
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if words else ends
        hashes = self.rolling.spans(self.rolling.prefix(joined), starts, ends)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        pairs = set()
        for state in self.automaton.next:
            for c, to in state.items():
                pairs |= {(c, d) for d in self.automaton.next[to]}
        self.pairs = np.array(sorted(a * len(words) + b for a, b in pairs), dtype=np.int64)
        self.shortest = min([window, *map(len, self.automaton.short)])
        self.first_of_short = np.array(sorted({s[0] for s in self.automaton.short}), dtype=np.int64)

    def _vocabulary_ids(self, hashes):
        out = np.full(len(hashes), -1, dtype=np.int64)
        if len(self.hashes):
            maybe = np.flatnonzero(self.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            same = self.hashes[at] == hashes[maybe]
            out[maybe[same]] = self.ids[at[same]]
        return out

    def __call__(self, buf, offsets):
        """Number of words of each text, and {text number: (spans, items)} of those with hits."""
        folded = self.lower[buf]
        starts, ends, first = word_bounds(folded, offsets, self.wordly)
        hits = {}
        if not len(starts) or not len(self.hashes):
            return np.diff(first), hits
        ids = self._vocabulary_ids(self.rolling.spans(self.rolling.prefix(folded), starts, ends))
        linked = (ids[:-1] >= 0) & (ids[1:] >= 0)
        cut = first[1:-1]
        linked[cut[(cut > 0) & (cut < len(ids))] - 1] = False
        at = np.flatnonzero(linked)
        if len(self.pairs):
            keys = ids[at] * len(self.automaton.vocabulary) + ids[at + 1]
            found = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            linked[at[self.pairs[found] != keys]] = False
        else:
            linked[at] = False
        edge = np.flatnonzero(~linked)
        begin = np.concatenate([np.zeros(1, np.int64), edge + 1])
        stop = np.concatenate([edge + 1, np.array([len(ids)])])
        keep = (stop - begin >= self.shortest) & (ids[begin] >= 0)
        if len(self.first_of_short):
            opens = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.isin(ids, self.first_of_short))])
            keep &= (stop - begin >= self.window) | (opens[stop] > opens[begin])
        else:
            keep &= stop - begin >= self.window
        owner = np.searchsorted(first, begin[keep], side="right") - 1
        data = folded.tobytes()
        for doc, a, b in zip(owner.tolist(), begin[keep].tolist(), stop[keep].tolist()):
            words = [data[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
            spans, items = self.stretch(words)
            if spans:
                base = int(first[doc])
                mine, names = hits.setdefault(doc, ([], set()))
                found = [(a + x - base, a + y - base, int(starts[a + x] - offsets[doc]), int(ends[a + y - 1] - offsets[doc])) for x, y in spans]
                if mine and mine[-1][1] == found[0][0]:
                    found[0] = (mine[-1][0], found[0][1], mine.pop()[2], found[0][3])
                mine += found
                names |= items
        return np.diff(first), hits

    def stretch(self, words):
        """Merged [first, end) word spans of the windows in a stretch, and the items they belong to."""
        machine, state, n = self.automaton, 0, 0
        spans, items = [], set()
        for i, word in enumerate(words):
            c = machine.vocabulary.get(word)
            state, n = (0, 0) if c is None else machine.step(state, n, c)
            longest = 0
            if n >= self.window:
                longest = self.window
                items |= machine.window_items[machine.window_state(state)]
            for size, name in machine.short_of(state) if machine.short_at else ():
                if size <= n:
                    longest = max(longest, size)
                    items.add(name)
            if longest:
                begin = i + 1 - longest
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, i + 1))
        return spans, items


def item_blocks(benchmark, item_id, text, block_words):
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        words = item_words(row[1])
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row[0] or "", words))
        size += len(words)
    yield block


def _scanner(items, window, hit_only=False):
    """Findings of the batches' last column, beside the columns before it; with ``hit_only``, of rows with hits."""
    def scan(batches):
        match = Matcher(items.value, window)
        for batch in batches:
            before, names = batch.columns[:-1], batch.schema.names[:-1]
            for a, b, buf, offsets in text_slices(batch.column(len(before))):
                counts, hits = match(buf, offsets)
                got = [hits.get(i) for i in range(b - a)]
                out = pa.RecordBatch.from_arrays([
                    *[column.slice(a, b - a) for column in before], pa.array(counts, pa.int64()),
                    pa.array([[{"first": w, "last": x, "start": y, "end": z} for w, x, y, z in g[0]] if g else [] for g in got], pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "last", "start", "end")]))),
                    pa.array([sorted(g[1]) if g else [] for g in got], pa.list_(pa.string())),
                ], names=[*names, "n_words", "spans", "items"])
                yield out.filter(pa.array([g is not None for g in got])) if hit_only else out
    return scan


def _united(rows, blocks, window, hit_only):
    """Findings of all blocks in each of the numbered rows (row, id, text)."""
    parts = [rows.mapInArrow(lean(_scanner(block, window, hit_only or k > 0)), f"row long, {SCAN_TYPE}") for k, block in enumerate(blocks)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    return union.groupBy("row", "id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).withColumn("spans", merged(F.col("spans")))


def _sent_blocks(spark, benchmark, item_id, text, block_words):
    return [spark.sparkContext.broadcast(block) for block in item_blocks(benchmark, item_id, text, block_words)]


def scan(docs, benchmark, doc_id="doc_id", text="text", item_id="item_id", item_text="text", window=WINDOW, block_words=BLOCK_WORDS):
    """One row per document: id (string), n_words, spans of hit words (word and byte bounds, merged) and item ids."""
    source = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    blocks = _sent_blocks(docs.sparkSession, benchmark, item_id, item_text, block_words)
    if len(blocks) == 1:
        return source.mapInArrow(lean(_scanner(blocks[0], window)), SCAN_TYPE)
    # Ids may repeat or be null, so rows are numbered; the numbers must be the same for every block.
    rows = stored(source.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "scanned")
    return _united(rows, blocks, window, hit_only=False).drop("row")


def merged(spans):
    """Spans of several blocks as their union, in order."""
    def put(done, s):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= s["first"])
        tail = F.try_element_at(done, F.lit(-1))
        longer = F.struct(tail["first"].alias("first"), F.greatest(tail["last"], s["last"]).alias("last"), tail["start"].alias("start"), F.greatest(tail["end"], s["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(s)))
    kind = "array<struct<first:int,last:int,start:int,end:int>>"
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), put)


def _cut(part, at, buf, offsets, counts, hits, limit):
    """A slice without the spans of ``hits`` ({row: spans}), and without the rows of which more than ``limit`` is hit."""
    data, keep, texts = buf.tobytes(), [], part.column(at).to_pylist()
    for i in range(part.num_rows):
        spans = hits.get(i, ())
        covered = sum(y - x for x, y, _, _ in spans)
        keep.append(not spans or covered <= limit * counts[i])
        if spans:
            out, done = [], int(offsets[i])
            for _, _, x, y in spans:
                out.append(data[done : int(offsets[i]) + x])
                done = int(offsets[i]) + y
            texts[i] = b"".join([*out, data[done : int(offsets[i + 1])]]).decode()
    columns = part.columns
    columns[at] = pa.array(texts, part.column(at).type)
    return pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(keep))


def _cleaner(items, window, at, limit):
    def clean(batches):
        match = Matcher(items.value, window)
        for batch in batches:
            for a, b, buf, offsets in text_slices(batch.column(at)):
                counts, hits = match(buf, offsets)
                part = batch.slice(a, b - a)
                yield _cut(part, at, buf, offsets, counts, {i: spans for i, (spans, _) in hits.items()}, limit) if hits else part
    return clean


def _span_cleaner(at, limit):
    """As ``_cleaner``, by the findings in the last two columns (n_words, spans)."""
    def clean(batches):
        for batch in batches:
            whole = batch.select(batch.schema.names[:-2])
            counts, spans = (batch.column(batch.num_columns - k) for k in (2, 1))
            for a, b, buf, offsets in text_slices(whole.column(at)):
                hits = {i: [tuple(s[k] for k in ("first", "last", "start", "end")) for s in row] for i, row in enumerate(spans.slice(a, b - a).to_pylist()) if row}
                part = whole.slice(a, b - a)
                yield _cut(part, at, buf, offsets, counts.slice(a, b - a).to_pylist(), hits, limit) if hits else part
    return clean


def decontaminate(docs, benchmark, text="text", item_id="item_id", item_text="text", window=WINDOW, coverage=0.5, block_words=BLOCK_WORDS):
    """Documents without the hit spans; those of which more than ``coverage`` of the words are hit go.

    All columns are kept.  A text without hits is returned unchanged, and null stays null.  Windows are those of
    the text as it came, whatever the blocks of items.
    """
    at = docs.columns.index(text)
    blocks = _sent_blocks(docs.sparkSession, benchmark, item_id, item_text, block_words)
    if len(blocks) == 1:
        return docs.mapInArrow(lean(_cleaner(blocks[0], window, at, coverage)), docs.schema)
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "contaminated")
    source = rows.select(F.col("__row").alias("row"), F.lit(None).cast("string").alias("id"), F.col(text).alias("text"))
    found = _united(source, blocks, window, hit_only=True).select(F.col("row").alias("__row"), F.col("n_words").alias("__n_words"), F.col("spans").alias("__spans"))
    judged = rows.join(found, "__row", "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__n_words", "__spans")
    return judged.mapInArrow(lean(_span_cleaner(at, coverage)), docs.schema)


def op5_decontaminate(spark, sf_dir):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return scan(docs, benchmark).select(
        F.col("id").cast("long").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
