"""Packing by shortest-pack-first over the length histogram.

``token_pieces`` encodes documents and cuts those above the capacity; ``pack_pieces`` places the pieces;
``sequences`` puts the packed sequences together.  Null and empty texts are one piece that holds only the
end id.  Equal rows are packed one by one; ties of a length are ranked by id, start and checksum, and rows
equal in all of these are interchangeable.  An empty table makes no pieces.  Input columns other than the
id and text are not read; ``pack_pieces`` keeps every column of its input.

The driver holds the histogram (one count a length, at most ``capacity``) and the patterns: each length opens
at most one new pack group and splits at most one, so there are at most 2 * ``capacity`` of them.
"""
import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import lean, text_slices, worker_cache
from .store import stored

CAPACITY = 4096
END_ID = 2
CACHED = 300_000  # words and parts of at most 64 bytes, in each of two generations of a worker's cache
SIGNS = b".,;:!?#$%&*()[]{}-_=+/|@^~`\"<>\\"
SLICE_ROWS = 500_000


def default_tokenizer():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def takes_words_apart(settings):
    """Whether a tokenizer folds case and takes letters, digits and signs apart, dropping white space."""
    folds = [n.get("type") for n in (settings.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    first = ((settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return folds and first.get("pattern") == {"Regex": WORDS} and (first.get("behavior"), first.get("invert")) == ("Removed", True)


class WordCache(dict):
    """Token bytes of white-space-separated words: the tokenizer drops white space and merges within words only.

    A word of letters with ASCII signs behind it is encoded as the letters, folded, and then the signs: the
    tokenizer takes them apart and folds case itself.  It does so after it has normalised them, so letters that end
    in a mark then (a dotted capital I, letters that composition leaves apart) stay with their signs.  A tokenizer of
    another kind encodes whole texts.

    Words and their parts share the cache, as a part alone has the ids of that word.  A full cache becomes the old
    generation, from which words that come again move to the new one: what comes once goes, what is frequent stays.
    """

    def __init__(self, json_text):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_str(json_text)
        self.old = {}
        settings = json.loads(json_text)
        self.apart = takes_words_apart(settings)
        letters = "abcdefghijklmnopqrstuvwxyz"
        whole = [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(letters)] == [letters] if self.apart else False
        self.plain = whole and not any(t["content"].isalpha() for t in settings.get("added_tokens") or [])

    def __missing__(self, word):
        ids = self.old.get(word)
        if ids is None:
            core = word.rstrip(SIGNS)
            parts = (core.lower(), word[len(core) :]) if self._is_letters(core, len(core) < len(word)) else (word,)
            if parts[0] == word or len(parts) == 1:
                ids = self._encoded(word)
            else:
                ids = self[parts[0]] + (self._signs(parts[1]) if parts[1] else b"")
        return self._kept(word, ids)

    def _kept(self, word, ids):
        if len(word) <= 64:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _signs(self, signs):
        ids = self.get(signs) or self.old.get(signs)
        if ids is None:
            ids = self._encoded(signs)
        return self._kept(signs, ids)

    def _encoded(self, word):
        """Ids of one word; lower-case ASCII letters are as they stand what the tokenizer hands its model."""
        if self.plain and word.isalpha() and word.islower():
            ids = [t.id for t in self.tokenizer.model.tokenize(word.decode())]
        else:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _is_letters(self, core, before_signs):
        if not core or core.isascii() or not before_signs:
            return core.decode().isalpha()
        text = core.decode()
        return text.isalpha() and self.tokenizer.normalizer.normalize_str(text)[-1].isalpha()

    def encode(self, text):
        """Little-endian unsigned 32-bit ids of a UTF-8 text."""
        if not self.apart:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


def word_cache(json_text):
    """The cache of this worker process, which several tasks use one after the other."""
    return worker_cache(("words", zlib.crc32(json_text.encode()), len(json_text)), lambda: WordCache(json_text))


PIECE_TYPE = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(json_text, capacity, end_id, with_ids):
    def pieces(batches):
        encoder, tail = word_cache(json_text.value), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            names = batch.column(0)
            for a, b, buf, offsets in text_slices(batch.column(1)):
                data, bounds = buf.tobytes(), offsets.tolist()
                row, start, length, crc, total, kept = [], [], [], [], [], []
                for i in range(b - a):
                    ids = encoder.encode(data[bounds[i] : bounds[i + 1]]) + tail
                    n = len(ids) // 4
                    for at in range(0, n, capacity):
                        part = ids[4 * at : 4 * (at + capacity)]
                        row.append(a + i)
                        start.append(at)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(n)
                        if with_ids:
                            kept.append(part)
                columns = [names.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                if with_ids:
                    flat = np.frombuffer(b"".join(kept), dtype="<u4").astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])
    return pieces


def token_pieces(docs, doc_id="doc_id", text="text", tokenizer=None, capacity=CAPACITY, end_id=END_ID, with_ids=True):
    """doc_id, start, length, ids_crc32, doc_tokens and, if wanted, ids (array<int>): each id lies in one piece."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(lean(_pieces(shipped, capacity, end_id, with_ids), True), PIECE_TYPE.format(kind) + ", ids array<int>" * with_ids)


def pack_histogram(counts, capacity):
    """{length: count} to [(count of packs, lengths in a pack)], lengths placed longest first.

    A length goes to the packs with the most room, that is the shortest ones, as long as any has room for it;
    what is left over opens new packs.
    """
    groups, roomy = {}, []  # by room: pack groups (count, lengths as a linked list); rooms, largest first

    def put(count, pack, room):
        if room not in groups:
            groups[room] = []
        if not groups[room]:
            heapq.heappush(roomy, -room)
        groups[room].append((count, pack))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while roomy and not groups[-roomy[0]]:
                heapq.heappop(roomy)
            room = -roomy[0] if roomy else -1
            if room < length:
                put(left, (None, length), capacity - length)
                break
            count, pack = groups[room].pop()
            used = min(count, left)
            if count > used:
                groups[room].append((count - used, pack))
            put(used, (pack, length), room - length)
            left -= used
    out = []
    for room in sorted(groups):
        for count, pack in groups[room]:
            lengths = []
            while pack:
                pack, length = pack
                lengths.append(length)
            out.append((count, lengths[::-1]))
    return out


def slots_of(patterns):
    """Sorted keys (length, first rank) of the slots and, for each, its first sequence and its offset."""
    rank, rows, sequence = {}, [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            at = rank.get(length, 0)
            rank[length] = at + count
            rows.append((length << 44 | at, sequence, offset))
            offset += length
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)


def _assign(slots, length_at, rank_at):
    def assign(batches):
        keys, first, offset = slots.value.T
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (length_at, rank_at))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            columns = [c for i, c in enumerate(batch.columns) if i != rank_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first[at] + rank - (keys[at] & ((1 << 44) - 1))), pa.array(offset[at])], names=[*(n for i, n in enumerate(batch.schema.names) if i != rank_at), "sequence_id", "offset"])
    return assign


def pack_pieces(pieces, capacity=CAPACITY, order=("doc_id", "start", "ids_crc32"), slice_rows=SLICE_ROWS):
    """Adds sequence_id and offset to pieces with a ``length`` from 1 to ``capacity``.

    Ranks within a length are counted in slices of about ``slice_rows`` rows or fewer, so that one length may hold any
    share of the pieces.
    """
    columns = pieces.columns
    salts = max(64, 1 + pieces.count() // slice_rows)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    counts = stored(counts, "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    slots = pieces.sparkSession.sparkContext.broadcast(slots_of(pack_histogram(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    rank = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)) - 1
    ranked = salted.withColumn("__rank", rank.cast("long")).join(bases, ["length", "__salt"]).select(*columns, (F.col("__rank") + F.col("__base")).alias("__rank"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(lean(_assign(slots, columns.index("length"), len(columns))), schema)


def sequences(packed, capacity=CAPACITY, pad_id=0):
    """One row per sequence: sequence_id, n_tokens and its ids, padded to ``capacity`` unless a power of two long."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda p: p["ids"]))
    n = F.sum("length")
    pad = F.array_repeat(F.lit(pad_id), F.when(F.bit_count(n) == 1, 0).otherwise(capacity - n).cast("int"))
    return packed.groupBy("sequence_id").agg(n.alias("n_tokens"), F.concat(ids, pad).alias("ids"))


def op4_pack(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_pieces(stored(token_pieces(docs, with_ids=False), "pieces"))
