"""Chroma audio fingerprints of media columns, and their alignment.

A recording is a byte column (strings are taken as UTF-8) of unsigned 8-bit mono samples.  Frames of ``FRAME`` samples,
``HOP`` apart, are windowed and transformed; spectral power is summed by pitch class and each frame scaled to length 1.
Sixteen filters compare sums of rectangles of the pitch-class picture, ``WIDTH`` frames wide, read off its integral
image; each value is quantised to four levels in Gray code, and the sixteen pairs of bits make one 32-bit integer for
each place of the picture.

Alignment: the distinct integers of a query recording, each at its first place, vote for the offset to the same integer's
first place in other recordings.  Every offset on which at least ``VOTES`` agree is tested: it is kept if few bits differ
over the whole overlap, or over a stretch of it that holds ``VOTES`` distinct integers equal in both.  The stretch is the
one whose bit errors stay furthest below the limit.

Null and empty columns are recordings without samples; recordings too short for one integer have no integers and align
with nothing.  Recordings with equal integers form a class, named by its smallest id (null ids aside), and take part in
alignments once; recordings without integers form a class if their bytes are equal, and null is its own class.  Repeated
rows fall into one class.  An empty table
gives an empty result.  Only the id and media columns are read.
"""
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from .arrays import text_slices
from .store import stored

RATE, FRAME, HOP, WIDTH = 11025, 256, 64, 16
LOWEST, HIGHEST = 160.0, 5000.0
LEVELS = (-0.12, 0.0, 0.12)
UNIT = 1 << 20
GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)
VOTES, BIT_ERRORS = 3, 0.2
FILTER_BITS = 1 << 24
MULTIPLIER = 1640531527
SEGMENT = 16
# (kind, first pitch class, pitch classes, frames); kinds: 0 sum, 1 low against high, 2 early against late,
# 3 checks, 4 middle pitches against the others, 5 middle frames against the others
FILTERS = [(0, 4, 3, 15), (4, 4, 6, 15), (1, 0, 4, 16), (3, 8, 2, 12), (3, 4, 4, 8), (4, 0, 3, 5), (1, 2, 2, 9), (2, 7, 3, 4),
           (2, 6, 2, 16), (2, 1, 3, 2), (5, 1, 10, 15), (3, 6, 2, 10), (2, 1, 1, 14), (3, 5, 6, 4), (1, 9, 2, 12), (3, 4, 2, 14)]


def pitch_matrix():
    """(bins, 12): which pitch class a frequency of the transform belongs to."""
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hertz), 12), dtype=np.float32)
    for i, f in enumerate(hertz):
        if LOWEST <= f <= HIGHEST:
            out[i, int(round(12 * np.log2(f / 440.0))) % 12] = 1
    return out


class Fingerprinter:
    def __init__(self):
        self.window = np.hanning(FRAME).astype(np.float32)
        self.pitch = pitch_matrix()

    def chroma(self, samples):
        """(frames, 12) of an array of unsigned 8-bit samples."""
        n = (len(samples) - FRAME) // HOP + 1
        if n <= 0:
            return np.zeros((0, 12), dtype=np.float32)
        out = np.empty((n, 12), dtype=np.float32)
        wave = (samples.astype(np.float32) - 128) / 128
        frames = np.lib.stride_tricks.sliding_window_view(wave, FRAME)[::HOP]
        for at in range(0, n, 8192):
            power = np.abs(np.fft.rfft(frames[at : at + 8192] * self.window, axis=1)).astype(np.float32) ** 2
            out[at : at + 8192] = power @ self.pitch
        return out

    def items(self, samples, bounds):
        """Fingerprints of recordings that lie one after the other in ``samples``."""
        sizes = np.maximum((np.diff(bounds) - FRAME) // HOP + 1, 0)
        pictures = [self.chroma(samples[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        picture = np.concatenate(pictures) if pictures else np.zeros((0, 12), np.float32)
        length = np.sqrt((picture**2).sum(axis=1, keepdims=True))
        picture = picture / np.maximum(length, 1e-6)
        n = len(picture) - WIDTH + 1
        ends = np.cumsum(sizes)
        if n <= 0:
            return [np.empty(0, np.uint32) for _ in sizes]
        # Whole numbers: sums are exact, so that areas don't depend on the recordings before.
        image = np.zeros((len(picture) + 1, 13), dtype=np.int64)
        image[1:, 1:] = np.cumsum(np.cumsum(np.rint(picture * UNIT).astype(np.int64), axis=0), axis=1)
        packed = np.zeros(n, dtype=np.uint32)
        for spec in FILTERS:
            packed = packed << np.uint32(2) | GRAY[np.searchsorted(LEVELS, self.apply(image, n, *spec, UNIT))]
        return [packed[end - size : max(end - size, end - WIDTH + 1)] for end, size in zip(ends.tolist(), sizes.tolist())]

    @staticmethod
    def apply(image, n, kind, first, high, wide, unit=1):
        def area(t0, t1, p0, p1):
            return (image[t1 : t1 + n, p1] - image[t1 : t1 + n, p0] - image[t0 : t0 + n, p1] + image[t0 : t0 + n, p0]) / unit
        low, top = first, first + high
        whole = area(0, wide, low, top)
        if kind == 0:
            return np.log1p(whole) - np.log1p(area(0, wide, 0, 12) * high / 12)
        if kind == 1:
            part = area(0, wide, low, low + high // 2)
        elif kind == 2:
            part = area(0, wide // 2, low, top)
        elif kind == 3:
            middle = low + max(high // 2, 1)
            part = area(0, wide // 2, low, middle) + area(wide // 2, wide, middle, top)
        elif kind == 4:
            part = area(0, wide, low + high // 3, top - high // 3)
        else:
            part = area(wide // 3, wide - wide // 3, low, top)
        return np.log1p(part) - np.log1p(whole - part)


def _class_names(ids, media, got):
    """Hashes of the integers; of the bytes where there are none, and of the id without bytes."""
    held = [g or (f"none {i}".encode() if m is None else b"bytes " + m) for i, m, g in zip(ids, media, got)]
    return [int(np.uint64(xxhash.xxh3_64_intdigest(h)).astype(np.int64)) for h in held]


def _fingerprints(batches):
    make = Fingerprinter()
    for batch in batches:
        for a, b, buf, offsets in text_slices(batch.column(1)):
            got, data = [x.astype("<u4").tobytes() for x in make.items(buf, offsets)], buf.tobytes()
            sizes = np.maximum((np.diff(offsets) - FRAME) // HOP + 1, 0)
            media = [None if null else data[x:y] for null, x, y in zip(batch.column(1).slice(a, b - a).is_null().to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array([len(g) // 4 for g in got], pa.int64()), pa.array(got, pa.binary()), pa.array([zlib.crc32(g) for g in got], pa.int64()), pa.array(_class_names(batch.column(0).slice(a, b - a).to_pylist(), media, got), pa.int64())], names=["id", "n_frames", "n_items", "items", "items_crc32", "class"])


def fingerprints(recordings, rec_id="doc_id", media="text"):
    """id, n_frames, n_items, items (little-endian 32-bit integers), items_crc32 and class (a 64-bit hash)."""
    kind = recordings.schema[rec_id].dataType.simpleString()
    return recordings.select(F.col(rec_id).alias("id"), F.col(media).alias("media")).mapInArrow(_fingerprints, f"id {kind}, n_frames long, n_items long, items binary, items_crc32 long, class long")


def slot(items):
    """Place of an item in the filter: the upper bits of a product, since items have structured lower bits."""
    return ((items.astype(np.uint64) * np.uint64(MULTIPLIER)) & np.uint64(0xFFFFFFFF)) >> np.uint64(8)


SEGMENT_TYPE = "class long, base long, segment long, items array<long>, places array<long>"


def _segments(bits):
    """Distinct items at their first places, in segments of ``SEGMENT`` places; with ``bits``, the items its filter lets
    through.  A segment is named by a hash of what it holds, relative to its base."""
    def segments(batches):
        table = None if bits is None else bits.value
        for batch in batches:
            out = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                items, first = np.unique(np.frombuffer(raw, dtype="<u4"), return_index=True)
                if table is not None:
                    at = slot(items).astype(np.int64)
                    ok = table[at >> 3] >> (at & 7) & 1 == 1
                    items, first = items[ok], first[ok]
                order = np.argsort(first)
                items, first = items[order].astype(np.int64), first[order].astype(np.int64)
                base = first // SEGMENT
                edge = np.flatnonzero(np.diff(base)) + 1
                for i, p in zip(np.split(items, edge), np.split(first, edge)) if len(items) else ():
                    start = int(p[0]) // SEGMENT * SEGMENT
                    out.append((name, start, int(np.uint64(xxhash.xxh3_64_intdigest(np.stack([i, p - start]).tobytes())).astype(np.int64)), i, p - start))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["class", "base", "segment", "items", "places"])
    return segments


def _items_of(segments):
    """(segment, item, place) of the distinct segments."""
    once = segments.dropDuplicates(["segment"]).select("segment", F.explode(F.arrays_zip("items", "places")).alias("z"))
    return once.select("segment", F.col("z.items").alias("item"), F.col("z.places").alias("place"))


def aligned_stretch(q, wrong):
    """(first, end) of the stretch with the largest surplus of allowed over actual bit errors, among those in which
    ``VOTES`` distinct integers are equal; ``wrong`` holds the bit errors of each place.  None if there is none."""
    gain = BIT_ERRORS * 32 - wrong.astype(float)
    equal = wrong == 0
    while len(np.unique(q[equal])) >= VOTES:
        total = np.concatenate([np.zeros(1), np.cumsum(gain)])
        end = int(np.argmax(total - np.minimum.accumulate(total)))
        first = int(np.argmin(total[: end + 1]))
        if len(np.unique(q[first:end][equal[first:end]])) >= VOTES:
            return first, end
        equal[first:end], gain[first:end] = False, -1e6
    return None


PASSED = ("offset", "votes", "overlap", "bit_errors", "start", "length", "stretch_errors")
KEPT_TYPE = f"query long, class long, {', '.join(f'{c} long' for c in PASSED)}, others array<struct<{','.join(f'{c}:long' for c in PASSED)}>>"


def _alignments(batches):
    """Pairs (query, class, offsets, q, r) of which an offset passes: the one with the most votes (the smaller one in
    size, then the smaller, on a tie), and the others.  The stretch starts at a place in the query."""
    for batch in batches:
        out = []
        for query, name, offsets, q, r in zip(*(c.to_pylist() for c in batch.columns)):
            q, r, passed = np.frombuffer(q, dtype="<u4"), np.frombuffer(r, dtype="<u4"), []
            for o in offsets:
                offset, votes = o["offset"], o["votes"]
                a, b = max(0, -offset), max(0, offset)
                n = min(len(q) - a, len(r) - b)
                wrong = np.bitwise_count(q[a : a + n] ^ r[b : b + n])
                errors = int(wrong.sum())
                found = aligned_stretch(q[a : a + n], wrong)
                if found is None and errors <= BIT_ERRORS * 32 * n:
                    found = 0, n
                if found:
                    passed.append((offset, votes, n, errors, a + found[0], found[1] - found[0], int(wrong[found[0] : found[1]].sum())))
            if passed:
                best, *others = sorted(passed, key=lambda x: (-x[1], abs(x[0]), x[0]))
                out.append((query, name, *best, [dict(zip(PASSED, x)) for x in others]))
        kinds = [pa.int64()] * (2 + len(PASSED)) + [pa.list_(pa.struct([(c, pa.int64()) for c in PASSED]))]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["query", "class", *PASSED, "others"])


def align(classes, queries):
    """query, class, offset (place in the class less place in the query), votes, overlap, bit_errors, and the stretch that
    aligns (start, length, stretch_errors), and the other offsets that pass (others), from (class, items) of all classes
    and of the queries among them."""
    spark = classes.sparkSession
    asked = stored(queries.select("class", "items").mapInArrow(_segments(None), SEGMENT_TYPE), "asked")
    wanted = _items_of(asked).select(F.col("segment").alias("q_segment"), "item", F.col("place").alias("at"))
    # A filter of fixed size spares the shuffle the items that no query has; if it fills up, more of them pass.
    place = F.shiftright((F.col("item") * MULTIPLIER) % (1 << 32), 8)
    slots = wanted.select(place.alias("s")).distinct().groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits"))
    words = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in slots.collect():
        words[r["w"]] = r["bits"]
    held = stored(classes.select("class", "items").mapInArrow(_segments(spark.sparkContext.broadcast(words.view(np.uint8))), SEGMENT_TYPE), "segments")
    # Votes between distinct segments; copies of a segment only meet again when whole votes are dealt to recordings.
    between = wanted.join(_items_of(held), "item").groupBy("q_segment", "segment", (F.col("place") - F.col("at")).alias("d")).agg(F.count("*").alias("n"))
    dealt = between.join(asked.select(F.col("segment").alias("q_segment"), F.col("class").alias("query"), F.col("base").alias("q_base")), "q_segment").join(held.select("segment", "class", "base"), "segment").where("query <> class")
    votes = dealt.groupBy("query", "class", (F.col("base") + F.col("d") - F.col("q_base")).alias("offset")).agg(F.sum("n").alias("votes"))
    tested = votes.where(F.col("votes") >= VOTES).groupBy("query", "class").agg(F.sort_array(F.collect_list(F.struct("offset", "votes"))).alias("offsets"))
    tested = stored(tested, "offsets")
    pairs = tested.join(queries.select(F.col("class").alias("query"), F.col("items").alias("q")), "query").join(classes.select("class", F.col("items").alias("r")), "class")
    return pairs.select("query", "class", "offsets", "q", "r").mapInArrow(_alignments, KEPT_TYPE)


def op1_chroma(spark, sf_dir):
    """Texts stand in for recordings.  One row per document; the row that names a class lists the query classes
    (those with an id divisible by 50) that align with it."""
    made = stored(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")), "fingerprints")
    classes = made.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"), F.max(F.col("id") % 50 == 0).alias("asked"))
    firsts = stored(made.where("n_items > 0").join(classes.withColumn("id", F.col("class_id")), ["class", "id"]).select("class", "class_id", "asked", "items").dropDuplicates(["class"]), "classes")
    found = align(firsts, firsts.where("asked"))
    names = firsts.select(F.col("class").alias("query"), F.col("class_id").alias("query_id"))
    matches = found.join(names, "query").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("query_id", *PASSED, "others"))).alias("matches"))
    joined = made.drop("items").join(classes, "class", "left").join(matches, "class", "left")
    first = F.col("id") == F.col("class_id")
    return joined.select(F.col("id").alias("doc_id"), "n_frames", "n_items", "items_crc32", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.when(first, F.col("matches")).alias("matches"))
