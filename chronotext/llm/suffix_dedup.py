"""Suffix-array dedup by the difference-cover algorithm, over the parts of the corpus that can repeat.

A byte is removed if it lies in a ``length``-byte string that also starts anywhere else, in the same text or another;
strings don't cross texts, and are judged on the input.

Each ``length``-byte window has an anchor: the position of the smallest hash of a ``GRAM``-byte string in it, which
equal windows share.  Windows whose anchor hash occurs once can't repeat and go no further.  The others meet in groups,
one for each anchor hash: a group holds the distinct contexts (the bytes under all windows of one anchor) with their
owners.  Groups are sorted by the difference-cover algorithm modulo 3: sampled triples are sorted and named, the string
of names is sorted by recursion, the remaining suffixes are sorted by their first byte and the sample's ranks, and the
two are merged; neighbours in the suffix array whose first ``length`` bytes are equal repeat.  A context with two owners
repeats as a whole.  Contexts of frequent anchors are first split by ranges of the window's place and the bytes all
windows of the range have in common.  What is alike over a whole range still meets in one task, as do the rows of one
anchor hash while they are counted: such a group grows with the owners of its anchor.

Texts are known by 64-bit hashes; equal texts are worked on once, and repeat as a whole if they have ``length`` bytes.
Null is the empty text; texts shorter than ``length`` keep all.  Ids may be null or repeated.  An empty table gives an
empty result.  ``removed`` reads the id and text columns; ``dedup`` carries all columns through.
"""
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from .arrays import Rolling, lean, text_slices
from .store import discard, stored

LENGTH = 200
GRAM = 48
PIECE = 8_000_000
FREQUENT, RANGE = 400, 16
SORTED_BYTES = 1_000_000
FILTER_BITS = 1 << 24
U = np.uint64


def text_id(data):
    return int(np.array([xxhash.xxh3_64_intdigest(data)], dtype=U).view(np.int64)[0])


class Anchors:
    """Anchor hash, text, first window, number of windows and the anchor's distance from the first window."""

    def __init__(self, length):
        self.length, self.rolling = length, Rolling()

    def __call__(self, buf, offsets):
        span = self.length - GRAM + 1
        n = len(buf) - self.length + 1
        sizes = np.maximum(np.diff(offsets) - self.length + 1, 0)
        if n <= 0 or not sizes.any():
            return (np.empty(0, np.int64),) * 5
        grams = len(buf) - GRAM + 1
        prefix = self.rolling.prefix(buf)
        hashes = prefix[GRAM:] - prefix[:grams]
        hashes *= self.rolling.inverse[:grams]
        hashes ^= hashes >> U(30)
        hashes *= U(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> U(27)
        hashes *= U(0x94D049BB133111EB)
        hashes ^= hashes >> U(31)
        low = (hashes & ~U(0xFFFFFF)) | np.arange(grams, dtype=U)
        step = 1
        while 2 * step <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[:n], low[span - step : span - step + n])
        place = (low & U(0xFFFFFF)).astype(np.int64)
        begin = offsets[:-1][sizes > 0]
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = place[1:] != place[:-1]
        fresh[begin] = True
        stop = begin + sizes[sizes > 0]
        inside = np.zeros(n + 1, dtype=np.int8)
        inside[begin] += 1
        np.add.at(inside, stop, -1)
        inside = np.cumsum(inside[:n]) > 0
        first = np.flatnonzero(fresh & inside)
        doc = np.searchsorted(offsets, first, side="right") - 1
        end = np.minimum(np.concatenate([first[1:], [n]]), (offsets[1:] - self.length + 1)[doc])
        return hashes[place[first]].view(np.int64), doc, first - offsets[doc], end - first, place[first] - first


def pieces(buf, offsets, length):
    """A slice as it is, or a very long text in overlapping pieces: (bytes, offsets, place of the first byte)."""
    if len(buf) <= PIECE:
        yield buf, offsets, 0
        return
    for at in range(0, max(len(buf) - length + 1, 1), PIECE):
        part = buf[at : at + PIECE + length - 1]
        yield part, np.array([0, len(part)]), at


def _profiles(batches):
    for batch in batches:
        for a, b, buf, offsets in text_slices(batch.column(1)):
            data, at = buf.tobytes(), offsets.tolist()
            texts = [data[x:y] for x, y in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([text_id(t) for t in texts], pa.int64()), pa.array(np.diff(offsets)), pa.array([hashlib.sha256(t).hexdigest() for t in texts])], names=["id", "tid", "n_bytes", "sha256"])


def _anchors(length):
    def anchors(batches):
        find, seen = Anchors(length), set()
        for batch in batches:
            for a, b, buf, offsets in text_slices(batch.column(0)):
                data, at = buf.tobytes(), offsets.tolist()
                tids = np.array([text_id(data[x:y]) for x, y in zip(at, at[1:])], dtype=np.int64)
                new = []
                for t in tids.tolist():
                    new.append(t not in seen)
                    if len(seen) < 1_000_000:
                        seen.add(t)
                for part, bounds, base in pieces(buf, offsets, length):
                    h, doc, first, n, lead = find(part, bounds)
                    keep = np.array(new)[doc] if len(doc) else np.empty(0, bool)
                    yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(tids[doc[keep]]), pa.array(first[keep] + base), pa.array(n[keep].astype(np.int32)), pa.array(lead[keep].astype(np.int32))], names=["h", "tid", "first", "n", "lead"])
    return anchors


def _texts(bits):
    def texts(batches):
        import zstandard
        table, pack, seen = bits.value, zstandard.ZstdCompressor(3), set()
        for batch in batches:
            for _, _, buf, offsets in text_slices(batch.column(0)):
                data, at, tids, packed = buf.tobytes(), offsets.tolist(), [], []
                for x, y in zip(at, at[1:]):
                    t = text_id(data[x:y])
                    slot = t % FILTER_BITS
                    if table[slot >> 6] >> (slot & 63) & 1 and t not in seen:
                        if len(seen) < 1_000_000:
                            seen.add(t)
                        tids.append(t)
                        packed.append(pack.compress(data[x:y]))
                yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int64()), pa.array(packed, pa.binary())], names=["tid", "packed"])
    return texts


def filter_bits(tids):
    """A filter of fixed size over text ids: bit i tells whether an id with remainder i is there."""
    slot = F.pmod("tid", F.lit(FILTER_BITS))
    rows = tids.select(slot.alias("s")).distinct().groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).collect()
    table = [0] * (FILTER_BITS // 64)
    for r in rows:
        table[r["w"]] = r["bits"] & (1 << 64) - 1
    return table


CONTEXT_TYPE = "g long, context binary, n int, tids array<long>, firsts array<long>"


def _contexts(length):
    def contexts(batches):
        import zstandard
        unpack = zstandard.ZstdDecompressor()
        held, size = {}, 0

        def flush():
            keys = list(held)
            out = pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary()), pa.array([len(k[1]) - length + 1 for k in keys], pa.int32()),
                pa.array([held[k][0] for k in keys], pa.list_(pa.int64())), pa.array([held[k][1] for k in keys], pa.list_(pa.int64()))], names=["g", "context", "n", "tids", "firsts"])
            held.clear()
            return out

        def put(g, context, tid, first):
            nonlocal size
            if (got := held.get((g, context))) is None:
                held[g, context] = [tid], [first]
                size += len(context) + 200
            else:
                got[0].append(tid)
                got[1].append(first)
                size += 16

        for batch in batches:
            for tid, packed, anchors in zip(*(batch.column(k).to_pylist() for k in range(3))):
                text = unpack.decompress(packed)
                for a in anchors:
                    h, first, n = a["h"], a["first"], a["n"]
                    if a["c"] <= FREQUENT:
                        put(h, text[first : first + n - 1 + length], tid, first)
                        continue
                    anchor, at = first + a["lead"], first
                    while at < first + n:
                        low = anchor + (at - anchor) // RANGE * RANGE  # windows from low to low + RANGE - 1 share the core
                        last = min(first + n - 1, low + RANGE - 1)
                        core = text[low + RANGE - 1 : low + length]
                        g = int(np.array([xxhash.xxh3_64_intdigest(core, seed=(h ^ (low - anchor)) & (1 << 64) - 1)], dtype=U).view(np.int64)[0])
                        put(g, text[at : last + length], tid, at)
                        at = last + 1
                if size > 16_000_000:
                    yield flush()
                    size = 0
        yield flush()
    return contexts


def suffix_array(s):
    """Suffix array of an int64 array of symbols from 1, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    top = int(s.max()) + 1
    t = np.concatenate([s, np.zeros(3, np.int64)])
    # An end position n that is 1 modulo 3 joins the sample, so that the two parts of the names don't run into each other.
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    triples = (t[sample] * top + t[sample + 1]) * top + t[sample + 2]
    order = np.argsort(triples)
    ordered = triples[order]
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
    if int(names.max()) < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + 4, dtype=np.int64)
    by_rank = sample[order]
    rank[by_rank] = np.arange(1, len(sample) + 1)
    by_rank = by_rank[by_rank < n]
    zeros = np.arange(0, n, 3)
    scale = n + 4
    key0 = t[zeros] * scale + rank[zeros + 1]
    order0 = np.argsort(key0)
    zeros, key0 = zeros[order0], key0[order0]
    first, second = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    before = np.searchsorted(t[first] * scale + rank[first + 1], key0)
    before += np.searchsorted((t[second] * top + t[second + 1]) * scale + rank[second + 2], (t[zeros] * top + t[zeros + 1]) * scale + rank[zeros + 2])
    out = np.empty(n, dtype=np.int64)
    at = np.arange(len(zeros)) + before
    rest = np.ones(n, dtype=bool)
    rest[at] = False
    out[at] = zeros
    out[rest] = by_rank
    return out


def repeated_starts(texts, counts, length):
    """For each text, the mask of its first ``counts`` places whose string of ``length`` bytes starts twice in all."""
    data = np.frombuffer(b"".join(t + b"\0" for t in texts), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    symbols = data.astype(np.int64) + 2
    symbols[begin[1:] - 1] = 1
    valid = np.zeros(len(data), dtype=bool)
    for b, c in zip(begin.tolist(), counts):
        valid[b : b + c] = True
    order = suffix_array(symbols)
    order = order[valid[order]]
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(len(data), dtype=U)
    for k in range(8):
        words |= wide[k : k + len(data)].astype(U) << U(8 * k)
    pair = np.arange(len(order) - 1)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        pair = pair[words[order[pair] + at] == words[order[pair + 1] + at]]
    twice = np.zeros(len(data), dtype=bool)
    twice[order[pair]] = twice[order[pair + 1]] = True
    return [twice[b : b + c] for b, c in zip(begin.tolist(), counts)]


def _repeats(length):
    def repeats(batches):
        groups, size = [], 0
        rows = ([], [], [])

        def out():
            done = pa.RecordBatch.from_arrays([pa.array(np.concatenate(r) if r else np.empty(0, np.int64), pa.int64()) for r in rows], names=["tid", "start", "end"])
            for r in rows:
                r.clear()
            return done

        def emit(mask, owners):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            starts, ends = edge[::2], edge[1::2] - 1 + length
            if len(starts):
                tids, firsts = np.array(owners[0], np.int64), np.array(owners[1], np.int64)
                rows[0].append(np.repeat(tids, len(starts)))
                rows[1].append((firsts[:, None] + starts[None, :]).ravel())
                rows[2].append((firsts[:, None] + ends[None, :]).ravel())

        def settle():
            texts, counts, owners = [], [], []
            for group in groups:
                if len(group) == 1:  # one context: nothing to sort
                    (context, (tids, firsts)), = group.items()
                    if len(tids) > 1:
                        emit(np.ones(len(context) - length + 1, dtype=bool), (tids, firsts))
                    continue
                for context, own in group.items():
                    texts.append(context)
                    counts.append(len(context) - length + 1)
                    owners.append(own)
            groups.clear()
            at = 0
            while at < len(texts):
                end, n = at, 0
                while end < len(texts):
                    n += len(texts[end]) + 1
                    end += 1
                for mask, own in zip(repeated_starts(texts[at:end], counts[at:end], length), owners[at:end]):
                    emit(np.ones(len(mask), dtype=bool) if len(own[0]) > 1 else mask, own)
                at = end

        current, group = None, {}
        for batch in batches:
            for g, context, tids, firsts in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if g != current:
                    if group:
                        groups.append(group)
                    if size > SORTED_BYTES:
                        settle()
                        size = 0
                        if sum(map(len, rows[0])) > 100_000:
                            yield out()
                    current, group = g, {}
                if (own := group.get(context)) is None:
                    group[context] = (tids, firsts)
                    size += len(context)
                else:
                    own[0].extend(tids)
                    own[1].extend(firsts)
        if group:
            groups.append(group)
        settle()
        yield out()
    return repeats


def _kept(with_text):
    def kept(batches):
        import zstandard
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for tid, packed, runs in zip(*(batch.column(k).to_pylist() for k in range(3))):
                text = unpack.decompress(packed)
                spans = []
                for r in sorted((r["start"], r["end"]) for r in runs):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
                parts, at = [], 0
                for x, y in spans:
                    parts.append(text[at:x])
                    at = y
                rest = b"".join([*parts, text[at:]])
                out.append((tid, len(text) - len(rest), [{"start": x, "end": y} for x, y in spans], hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([o[3] for o in out], pa.string()), pa.array([o[4] for o in out], pa.binary())], names=["tid", "n_removed", "spans", "kept_sha256", "kept"])
    return kept


def analysed(docs, doc_id, text, length, with_text):
    """(profiles, copies, changed): per row id, tid, n_bytes, sha256; ids of texts with copies; what is left of texts
    with repeated strings (tid, n_removed, spans, kept_sha256, kept)."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    profiles = stored(docs.mapInArrow(lean(_profiles), f"id {kind}, tid long, n_bytes long, sha256 string"), "profiles")
    copies = profiles.groupBy("tid").agg(F.count("*").alias("copies")).where("copies > 1")
    anchors = docs.select("text").mapInArrow(lean(_anchors(length)), "h long, tid long, first long, n int, lead int")
    shared = anchors.withColumn("c", F.count("*").over(Window.partitionBy("h"))).where("c > 1")
    shared = stored(shared.select("tid", F.struct("h", "first", "n", "lead", "c").alias("a")), "anchors")
    bits = filter_bits(shared.select("tid"))
    own = shared.groupBy("tid").agg(F.collect_list("a").alias("anchors"))
    texts = docs.select("text").mapInArrow(lean(_texts(spark.sparkContext.broadcast(bits))), "tid long, packed binary")
    texts = stored(texts.groupBy("tid").agg(F.min("packed").alias("packed")).join(shared.select("tid").distinct(), "tid", "left_semi"), "texts")
    parts = texts.join(own, "tid").select("tid", "packed", "anchors").mapInArrow(lean(_contexts(length)), CONTEXT_TYPE)
    runs = stored(parts.repartition("g").sortWithinPartitions("g").mapInArrow(lean(_repeats(length)), "tid long, start long, end long"), "runs")
    discard(shared)
    runs = runs.groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    changed = texts.join(runs, "tid").select("tid", "packed", "runs").mapInArrow(lean(_kept(with_text)), "tid long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary")
    return profiles, copies, changed


def removed(docs, doc_id="doc_id", text="text", length=LENGTH):
    """One row per document: id, n_bytes, n_removed, spans of removed bytes and the SHA-256 of what is kept."""
    profiles, copies, changed = analysed(docs, doc_id, text, length, False)
    whole = F.col("copies").isNotNull() & (F.col("n_bytes") >= length)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    nothing = F.array().cast("array<struct<start:long,end:long>>")
    return profiles.join(copies, "tid", "left").join(changed.drop("kept"), "tid", "left").select(
        "id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, all_of_it).otherwise(F.coalesce("spans", nothing)).alias("spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"))


def _with_id(at, bits, inside):
    """Rows whose text's id the filter lets through, with the id; or the other rows."""
    def with_id(batches):
        table = bits.value
        for batch in batches:
            tids = []
            for _, _, buf, offsets in text_slices(batch.column(at)):
                data, bounds = buf.tobytes(), offsets.tolist()
                tids += [text_id(data[x:y]) for x, y in zip(bounds, bounds[1:])]
            hit = [table[t % FILTER_BITS >> 6] >> (t % FILTER_BITS & 63) & 1 == 1 for t in tids]
            if inside:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tids, pa.int64())], names=[*batch.schema.names, "__tid"]).filter(pa.array(hit, pa.bool_()))
            else:
                yield batch.filter(pa.array([not h for h in hit], pa.bool_()))
    return with_id


def _cut(at):
    def cut(batches):
        for batch in batches:
            column, spans = batch.column(at), batch.column(batch.num_columns - 1).to_pylist()
            texts = column.to_pylist()
            for i, runs in enumerate(spans):
                data, parts, done = (texts[i] or "").encode(), [], 0
                for r in runs or ():
                    parts.append(data[done : r["start"]])
                    done = r["end"]
                if runs:
                    texts[i] = b"".join([*parts, data[done:]]).decode("utf-8", "ignore")
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, column.type)
            keep = [not s or bool(t) for s, t in zip(spans, texts)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))
    return cut


def dedup(docs, doc_id="doc_id", text="text", length=LENGTH):
    """The documents without the repeated strings; those of which nothing is left go.  All columns stay.

    A character of which some bytes go is left out.  Of equal texts none keeps a repeated string: let another operator
    choose among copies first."""
    from pyspark.sql import types as T
    _, copies, changed = analysed(docs, doc_id, text, length, False)
    runs = stored(changed.select(F.col("tid").alias("__tid"), "spans"), "spans")
    whole = stored(copies.select(F.col("tid").alias("__tid"), F.lit(True).alias("__copied")), "copies")
    # Only texts that may change are dealt by their ids; the others stay where they were read.
    bits = docs.sparkSession.sparkContext.broadcast(filter_bits(runs.select(F.col("__tid").alias("tid")).unionAll(whole.select(F.col("__tid").alias("tid")))))
    at = docs.columns.index(text)
    same = docs.mapInArrow(lean(_with_id(at, bits, False)), docs.schema)
    marked = docs.mapInArrow(lean(_with_id(at, bits, True)), T.StructType([*docs.schema.fields, T.StructField("__tid", T.LongType())]))
    n = F.octet_length(F.col(text)).cast("long")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end")))
    joined = marked.join(runs, "__tid", "left").join(whole, "__tid", "left")
    spans = F.when(F.col("__copied") & (n >= length), everything).otherwise(F.col("spans"))
    cut = joined.select(*(F.col(c) for c in docs.columns), spans.alias("__spans")).mapInArrow(lean(_cut(at)), docs.schema)
    return same.unionAll(cut)


def op6_suffix_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return removed(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
