"""Entities by a gazetteer: leftmost-longest phrases of a table in texts, with a whitelist of labels.

Texts are dealt to blocks by their content.  A block asks only for the distinct phrases that it may hold, as 64-bit hashes
that pass a bitmap of the gazetteer's (2 MB, whatever its size); those that the gazetteer has meet the block's texts in one
task, so neither all texts nor the gazetteer have to fit a task, and places of words are never shuffled.  Of the spans of a
text the first goes, of those that start together the longest, then the next that starts behind it.  A phrase with several
labels has the least of them.  Null and empty texts have no entities; repeated keys are one text for each row.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut

SPAN = "array<struct<start:int,n:int,phrase:string,label:string>>"
BLOCK = 1024
PLACES = 1 << 18  # of 64 bits each, in the bitmap
WORDS = 1 << 18  # of the texts that are gone through at once; one longer text is taken alone


def _words(column):
    """The flat hashes of an array column, and where each row's begin and end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def _slices(rows, name):
    """Rows in slices of at most ``WORDS`` words, or of one text: arrays over a batch's words and their phrases are many."""
    column = rows[name] if isinstance(rows, pa.Table) else rows.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    upto = np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    at = 0
    while at < len(upto):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WORDS, side="right")))
        yield rows.slice(at, to - at)
        at = to


def _phrases(words, bounds, longest):
    """For each length the hashes of the phrases from each word on, and where such a phrase stays inside its text."""
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(words))
    h = np.zeros(len(words), np.uint64)
    for n in range(1, longest + 1):
        h = h[: max(len(words) - n + 1, 0)]
        h = (h ^ words[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        yield n, h, left[: len(h)] >= n


def _whole(batches):
    """The hash of each row's words as one phrase."""
    for batch in batches:
        words, bounds = _words(batch.column(0))
        out = np.zeros(len(batch), np.uint64)
        for n, h, inside in _phrases(words, bounds, int(np.diff(bounds).max(initial=0))):
            own = np.flatnonzero(np.diff(bounds) == n)
            out[own] = h[bounds[own]]
        yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), *batch.columns[1:]], names=["h", *batch.schema.names[1:]])


def _asked(bitmap, lengths):
    """(block, h): the phrases that a block's texts may hold."""
    def asked(batches):
        held = bitmap.value
        for batch in (part for whole in batches for part in _slices(whole, "hs")):
            words, bounds = _words(batch.column(1))
            block = np.repeat(batch.column(0).to_numpy(), np.diff(bounds))
            found = []
            for n, h, inside in _phrases(words, bounds, max(lengths, default=0)):
                if n in lengths:
                    bits = held[h & np.uint64(PLACES - 1)] >> (h >> np.uint64(18) & np.uint64(63))
                    at = np.flatnonzero(inside & (bits & np.uint64(1) > 0))
                    found.append(np.stack([block[at], h[at].view(np.int64)]))
            both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            order = np.lexsort(both)
            both = both[:, order]
            first = np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any(0)]) if len(order) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(both[0][first]), pa.array(both[1][first])], names=["block", "h"])
    return asked


def _found(lengths, schema):
    """The spans of a block's texts, given the phrases that they have."""
    def found(texts: pa.Table, phrases: pa.Table) -> pa.Table:
        phrases = phrases.sort_by("h").combine_chunks()
        parts = [some(part, phrases) for part in _slices(texts, "hs")]
        return pa.concat_tables(parts) if parts else some(texts, phrases)

    def some(texts, phrases):
        words, bounds = _words(texts["hs"])
        known = phrases["h"].to_numpy().view(np.int64)
        length, which = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for n, h, inside in _phrases(words, bounds, max(lengths, default=0)):
            if n in lengths and len(known):
                at = np.minimum(np.searchsorted(known, h.view(np.int64)), len(known) - 1)
                hit = np.flatnonzero(inside & (known[at] == h.view(np.int64)))
                length[hit], which[hit] = n, at[hit]
        starts, kept, end = np.flatnonzero(length), [], 0
        for start, n in zip(starts.tolist(), length[starts].tolist()):
            if start >= end:
                kept.append(start)
                end = start + n
        kept = np.array(kept, np.int64)
        text = np.searchsorted(bounds, kept, side="right") - 1
        take = pa.array(which[kept])
        columns = [pa.array(kept - bounds[text], pa.int32()), pa.array(length[kept], pa.int32()), *(phrases[c].take(take).combine_chunks() for c in ("phrase", "label"))]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        spans = pa.StructArray.from_arrays(columns, names=["start", "n", "phrase", "label"])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
        return pa.table([texts["key"], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], names=schema)
    return found


def entities(df: DataFrame, key: str, words: Column, gazetteer: DataFrame, labels=None, person: str = "PERSON") -> DataFrame:
    """(key, entities, persons, n_entities) of every row; ``gazetteer`` has (phrase, label), phrases of words parted by
    single spaces, ``labels`` names those that count."""
    spark = df.sparkSession
    chosen = gazetteer.where(F.col("phrase").isNotNull() & (F.col("phrase") != ""))
    if labels is not None:
        chosen = chosen.where(F.col("label").isin(*labels))
    hashes = lambda ws: F.transform(ws, lambda w: F.xxhash64(w))
    parts = chosen.groupBy("phrase").agg(F.min("label").alias("label")).withColumn("ps", F.split("phrase", " "))
    phrases = cut(parts.select(hashes(F.col("ps")).alias("hs"), F.size("ps").alias("n"), "phrase", "label").mapInArrow(_whole, "h long, n int, phrase string, label string"))
    lengths = {r["n"] for r in phrases.select("n").distinct().collect()}
    bits = phrases.groupBy(F.col("h").bitwiseAND(F.lit(PLACES - 1)).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 18) & 63 as int))")).alias("bits"))
    bitmap = np.zeros(PLACES, np.uint64)
    for r in bits.toLocalIterator():
        bitmap[r["at"]] = r["bits"] & (1 << 64) - 1
    blocks = 1 + df.count() // BLOCK
    texts = df.select(F.col(key).alias("key"), hashes(words).alias("hs")).withColumn("block", F.pmod(F.xxhash64("key", "hs"), F.lit(blocks)))
    asked = texts.select("block", "hs").mapInArrow(_asked(spark.sparkContext.broadcast(bitmap), lengths), "block long, h long").distinct()
    known = asked.join(phrases.select("h", "phrase", "label"), "h").select("block", "h", "phrase", "label")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("entities", T._parse_datatype_string(SPAN))])
    out = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_found(lengths, schema.names), schema)
    persons = F.transform(F.filter("entities", lambda e: e["label"] == person), lambda e: e["phrase"])
    return out.select(key, "entities", persons.alias("persons"), F.size("entities").alias("n_entities"))
