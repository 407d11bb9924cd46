"""Language-model scoring by context-tree weighting over bytes, beside a smoothed word unigram.

A text is its words, folded (A-Z to a-z), with single spaces between and one end symbol behind: the byte 0xFF, which
UTF-8 never uses and which also fills the context before the first byte.  Each byte is eight binary decisions; a
decision has a node for each context of the last 0 to ``DEPTH`` bytes.  A node's estimate is Krichevsky-Trofimov's, and
a node weighs its own estimate against its children's by the evidence of all training texts, as context-tree weighting
does; a child without training data is left out.  The weights are those after all training texts and stay fixed.

Null and empty texts have the end symbol alone.  Rows are scored one by one: repeated rows get equal scores and, in
training, all count.  Without training rows every decision has probability 1/2.  Ids may be null.  An empty table gives
an empty result.  Only the named columns are read.

The corpus is gone through once, in chunks of at most ``CHUNK_BYTES`` (or one text).  A chunk keeps its texts, packed,
and its distinct words and (DEPTH + 1)-grams with their counts in training texts; keys and counts are summed and joined
in shuffles over all keys, and each chunk gets back the values of its own keys, streamed before its texts.  No table of the corpus is broadcast:
the driver sees the nodes of the two shortest contexts only, at most 256 * 256 of them.  Words are known by 64-bit hashes.
"""
import io
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from .arrays import lean, lower_table
from .store import discard, stored

DEPTH = 4
CHUNK_BYTES = 12_000_000
SLICE = 1_000_000
NODES_A_BUCKET = 300_000
FOLD = bytes(lower_table())
PAD = b"\xff" * DEPTH
GRAM, WORD, BLOCK = 0, 1, 2
CHUNK_TYPE = "chunk long, kind int, key long, n long, block binary"


def normalised(text):
    return b" ".join(text.translate(FOLD).split())


def gram_keys(data):
    """Keys of the (DEPTH + 1)-grams of a byte array, oldest byte first."""
    buf = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    n = len(buf) - DEPTH
    key = buf[:n].copy()
    for i in range(1, DEPTH + 1):
        key <<= 8
        key |= buf[i : i + n]
    return key


def predicted(lengths):
    """Positions among the grams of padded texts, one after the other, that belong to one text."""
    size = lengths + DEPTH + 1
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    keep = np.ones(max(int(size.sum()) - DEPTH, 0), dtype=bool)
    for k in range(1, DEPTH + 1):  # grams that end in the padding of the next text
        at = start[1:] - k
        keep[at] = False
    return keep


def slices(texts):
    """(first text, end, gram keys, number of grams by text) of about ``SLICE`` bytes; a longer text makes several."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
            size += len(texts[end])
            end += 1
        whole = b"".join(PAD + t + b"\xff" for t in texts[at:end])
        if size > SLICE:
            for a in range(0, size + 1, SLICE):
                keys = gram_keys(whole[a : a + SLICE + DEPTH])
                yield at, end, keys, np.array([len(keys)])
        else:
            lengths = np.array([len(t) for t in texts[at:end]], dtype=np.int64)
            yield at, end, gram_keys(whole)[predicted(lengths)], lengths + 1
        at = end


def gram_counts(texts):
    """Distinct gram keys of the texts and how often each occurs."""
    keys, counts = [], []
    for _, _, grams, _ in slices(texts):
        k, c = np.unique(grams, return_counts=True)
        keys.append(k)
        counts.append(c)
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)


def word_keys(words):
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64).astype(np.int64)


END_KEY = int(np.array([xxhash.xxh3_64_intdigest(b"")], dtype=np.uint64).astype(np.int64)[0])


def packed(ids, held, texts):
    import zstandard
    sink = io.BytesIO()
    batch = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(held, pa.bool_()), pa.array(texts, pa.large_binary())], names=["id", "held", "text"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.compress(sink.getvalue(), 3)


def unpacked(block):
    import zstandard
    return pa.ipc.open_stream(zstandard.decompress(block)).read_all().combine_chunks()


def _chunks(batches):
    ids, held, texts, size, number = [], [], [], 0, 0

    def chunk():
        key = int(np.array([xxhash.xxh3_64_intdigest(b"".join(t[:64] for t in texts[:1000]) + str((number, len(texts), size, partition)).encode())], dtype=np.uint64).astype(np.int64)[0])
        train = [t for t, h in zip(texts, held) if not h]
        rest = [t for t, h in zip(texts, held) if h]
        k, c = gram_counts(train)
        k2, _ = gram_counts(rest)
        k2 = k2[~np.isin(k2, k)]
        yield from rows(key, GRAM, np.concatenate([k, k2]), np.concatenate([c, np.zeros(len(k2), np.int64)]))
        words = Counter()
        for t in train:
            words.update(t.split())
        words[b""] = len(train)
        for t in rest:
            for w in set(t.split()):
                words.setdefault(w, 0)
        yield from rows(key, WORD, word_keys(words), np.fromiter(words.values(), np.int64, len(words)))
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([None], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([packed(ids, held, texts)], pa.binary())], names=["chunk", "kind", "key", "n", "block"])

    def rows(key, kind, keys, counts):
        for at in range(0, len(keys), 200_000):
            part = keys[at : at + 200_000]
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(np.full(n, kind, np.int32)), pa.array(part), pa.array(counts[at : at + n]), pa.nulls(n, pa.binary())], names=["chunk", "kind", "key", "n", "block"])

    from pyspark import TaskContext
    partition = TaskContext.get().partitionId()
    for batch in batches:
        got = [normalised((t or "").encode()) for t in batch.column(2).to_pylist()]
        for i, t in enumerate(got):
            if texts and size + len(t) > CHUNK_BYTES:
                yield from chunk()
                ids, held, texts, size, number = [], [], [], 0, number + 1
            size += len(t)
            ids.append(batch.column(0).slice(i, 1))
            held.append(bool(batch.column(1)[i].as_py()))
            texts.append(t)
    if texts:
        yield from chunk()


def lgamma(x):
    """log Gamma for x >= 0.5, by Stirling's series after a shift."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def evidence(n0, n1):
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - np.log(np.pi) - lgamma(n0 + n1 + 1.0)


def weigh(own, children):
    """Log of the weighted probability of a node and the weight of its own estimate; ``children`` summed logs."""
    top = np.maximum(own, children)
    both = top + np.log(0.5 * np.exp(own - top) + 0.5 * np.exp(children - top))
    return both, np.exp(np.log(0.5) + own - both)


def bit_nodes(byte):
    """(8, n) numbers 1 to 255 of the binary nodes on the way to a byte, and the bits taken there."""
    byte = byte.astype(np.int64)
    node = np.stack([(1 << j) | (byte >> (8 - j)) for j in range(8)])
    bit = np.stack([(byte >> (7 - j)) & 1 for j in range(8)])
    return node, bit


class Level:
    """Nodes of one context depth for an array of grams."""

    def __init__(self, keys, counts, depth):
        node, self.bit = bit_nodes(keys & 255)
        context = (keys >> 8) & ((1 << (8 * depth)) - 1)
        ids = (context[None, :] << 8) | node
        self.ids, self.at = np.unique(ids, return_inverse=True)
        self.at = self.at.reshape(ids.shape)
        weight = np.broadcast_to(counts, ids.shape)
        ones = np.bincount(self.at.ravel(), weights=(weight * self.bit).ravel(), minlength=len(self.ids))
        both = np.bincount(self.at.ravel(), weights=weight.ravel(), minlength=len(self.ids))
        self.n0, self.n1 = both - ones, ones
        self.own = evidence(self.n0, self.n1)
        self.log, self.weight = self.own, np.ones(len(self.ids))

    def over(self, deeper, depth):
        """Takes the children's evidence in; depth: of this level."""
        parent = ((deeper.ids >> 8) & ((1 << (8 * depth)) - 1)) << 8 | (deeper.ids & 255)
        total = np.bincount(np.searchsorted(self.ids, parent), weights=deeper.log, minlength=len(self.ids))
        self.log, self.weight = weigh(self.own, total)

    def estimate(self):
        """Probability of the bit taken, the node's own weight, and whether the node was seen, each (8, n)."""
        n0, n1 = self.n0[self.at], self.n1[self.at]
        return (np.where(self.bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1), self.weight[self.at], (n0 + n1) > 0


def levels(keys, counts):
    """Levels of depth 2 to DEPTH, weighed."""
    out = [Level(keys, counts, d) for d in range(2, DEPTH + 1)]
    for d in range(DEPTH - 1, 1, -1):
        out[d - 2].over(out[d - 1], d)
    return out


def _deep_evidence(table):
    keys, counts = (table.column(i).to_numpy() for i in (1, 2))
    top = levels(keys, counts)[0]
    return pa.table({"context": (top.ids >> 8) & 255, "node": top.ids & 255, "log": top.log})


def _gram_values(shallow):
    def values(table):
        keys, counts = (table.column(i).to_numpy() for i in (1, 2))
        steps = [level.estimate() for level in levels(keys, counts)]
        node, bit = bit_nodes(keys & 255)
        context = (keys >> 8) & 255
        for n0, n1, weight in shallow.value[::-1]:  # of depth 1, then of depth 0
            at = (context[None, :] if n0.shape[0] > 1 else np.zeros_like(node), node)
            a, b = n0[at], n1[at]
            steps.insert(0, ((np.where(bit == 1, b, a) + 0.5) / (a + b + 1), weight[at], (a + b) > 0))
        p, _, _ = steps[-1]
        seen = steps[-1][2]
        for own, weight, here in steps[-2::-1]:
            p = np.where(seen, weight * own + (1 - weight) * p, own)
            seen = here
        return pa.table({"key": keys, "value": np.log10(p).sum(axis=0)})
    return values


def shallow_nodes(pairs, deep):
    """Counts and weights of depth 0 and 1 from (context byte, byte, n) and summed evidence (context byte, node, log)."""
    n = np.zeros((256, 2, 256))
    for context, byte, count in pairs:
        node, bit = bit_nodes(np.array([byte]))
        n[context, bit[:, 0], node[:, 0]] += count
    below = np.zeros((256, 256))
    for context, node, log in deep:
        below[context, node] = log
    log1, weight1 = weigh(evidence(n[:, 0], n[:, 1]), below)
    n0 = n.sum(axis=0, keepdims=True)
    _, weight0 = weigh(evidence(n0[:, 0], n0[:, 1]), log1.sum(axis=0, keepdims=True))
    return [(n0[:, 0], n0[:, 1], weight0), (n[:, 0], n[:, 1], weight1)]


class Lookup:
    """Values of int64 keys by hash tables of falling size; every key asked for must be there."""

    def __init__(self, keys, values):
        self.levels = []
        seed = 0x9E3779B97F4A7C15
        while len(keys) > 64 and len(self.levels) < 8:
            bits = max(8, int(len(keys)).bit_length() + 1)
            seed = (seed * 0xD1342543DE82EF95 + 1) % (1 << 64) | 1
            at = self._slot(keys, seed, bits)
            table = np.full(1 << bits, -1, dtype=np.int64)
            table[at] = keys
            held = np.zeros(1 << bits)
            won = table[at] == keys
            held[at[won]] = values[won]
            self.levels.append((seed, bits, table, held))
            keys, values = keys[~won], values[~won]
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    @staticmethod
    def _slot(keys, seed, bits):
        return ((keys.view(np.uint64) * np.uint64(seed)) >> np.uint64(64 - bits)).view(np.int64)

    def __call__(self, keys):
        out = np.empty(len(keys))
        left = None
        for seed, bits, table, held in self.levels:
            asked = keys if left is None else keys[left]
            at = self._slot(asked, seed, bits)
            hit = table[at] == asked
            if left is None:
                out = held[at]
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = held[at[hit]]
                left = left[~hit]
        rest = keys if left is None else keys[left]
        if len(rest):
            values = self.values[np.searchsorted(self.keys, rest)]
            if left is None:
                return values
            out[left] = values
        return out


RESULT = "doc_id {}, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double"


def _scores(total):
    """Scores of the texts of each chunk, from rows (chunk, kind, key, value, block) sorted by chunk and kind: the values
    of its grams, those of its words and, at the end, its texts."""
    def scored(block, grams, words):
        n_all, v = total.value
        lookup = Lookup(*(np.concatenate([x[i] for x in grams]) if grams else np.empty(0, t) for i, t in enumerate((np.int64, float))))
        grams.clear()
        counts = {k: n for keys, values in words for k, n in zip(keys.tolist(), values.tolist())}
        words.clear()

        class Words(dict):
            def __missing__(self, word):
                c = counts[int(np.uint64(xxhash.xxh3_64_intdigest(word)).astype(np.int64))]
                self[word] = got = (np.log10((c + 0.5) / (n_all + 0.5 * (v + 1))), c > 0)
                return got

        known, docs = Words(), unpacked(block)
        texts = docs.column("text").to_pylist()
        score = np.zeros(len(texts))
        for at, end, keys, sizes in slices(texts):
            score[at:end] += np.add.reduceat(lookup(keys), np.concatenate([[0], np.cumsum(sizes)])[:-1])
        base, n, got = [], [], []
        end_value, end_known = known[b""]
        for t in texts:
            pairs = [known[w] for w in t.split()]
            base.append(sum(p[0] for p in pairs) + end_value)
            n.append(len(pairs) + 1)
            got.append(sum(p[1] for p in pairs) + end_known)
        columns = {"doc_id": docs.column("id"), "held_out": docs.column("held"), "n_bytes": pa.array([len(t) + 1 for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(got, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score)}
        yield from pa.table(columns).to_batches()

    def scores(batches):
        grams, words = [], []
        for batch in batches:
            kind, key, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            start = 0
            for at in [*np.flatnonzero(kind == BLOCK).tolist(), None]:
                for k, out in ((GRAM, grams), (WORD, words)):
                    here = np.flatnonzero(kind[start:at] == k) + start
                    if len(here):
                        out.append((key[here], value[here]))
                if at is not None:
                    yield from scored(batch.column(4)[at].as_py(), grams, words)
                    start = at + 1
    return scores


def score(docs, held_out, doc_id="doc_id", text="text"):
    """One row per document: doc_id, held_out, n_bytes (with the end), n_tokens, n_known, train_tokens, base_score,
    score (log10 probabilities) and code_length (bits per byte).  ``held_out``: Column, true for rows not learnt from."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    chunks = stored(source.mapInArrow(lean(_chunks), CHUNK_TYPE), "chunks")
    asked = chunks.where(F.col("kind").isNotNull()).select("chunk", "kind", "key", "n")
    # Grams: summed over the corpus, then valued in groups that share the last two context bytes.
    grams = stored(asked.where(F.col("kind") == GRAM).groupBy("key").agg(F.sum("n").alias("n")), "grams")
    buckets = 1 + grams.count() // NODES_A_BUCKET
    bucketed = grams.select(F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(0xFFFF)), F.lit(buckets)).alias("bucket"), "key", "n")
    deep = bucketed.groupBy("bucket").applyInArrow(_deep_evidence, "context long, node long, log double").groupBy("context", "node").agg(F.sum("log").alias("log"))
    pairs = grams.groupBy(F.shiftright("key", 8).bitwiseAND(0xFF).alias("context"), F.col("key").bitwiseAND(0xFF).alias("byte")).agg(F.sum("n").alias("n"))
    shallow = sc.broadcast(shallow_nodes(pairs.collect(), deep.collect()))
    values = bucketed.groupBy("bucket").applyInArrow(_gram_values(shallow), "key long, value double")
    # Words: summed over the corpus.
    words = asked.where(F.col("kind") == WORD)
    summed = words.groupBy("key").agg(F.sum("n").cast("double").alias("value"))
    summed = stored(summed, "words")
    total = summed.agg(F.coalesce(F.sum("value"), F.lit(0.0)), F.count_if(F.col("value") > 0)).first()
    nothing = F.lit(None).cast("binary").alias("block")
    answers = [t.select("chunk", "kind", "key", "value", nothing) for t in (asked.where(F.col("kind") == GRAM).join(values, "key"), words.join(summed, "key"))]
    blocks = chunks.where(F.col("kind").isNull()).select("chunk", F.lit(BLOCK).alias("kind"), F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("value"), "block")
    rows = answers[0].unionAll(answers[1]).unionAll(blocks).repartition("chunk").sortWithinPartitions("chunk", "kind")
    scored = rows.mapInArrow(lean(_scores(sc.broadcast((total[0], total[1])))), RESULT.format(kind))
    scored = stored(scored.withColumns({"train_tokens": F.lit(int(total[0])).cast("long"), "code_length": -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")}), "scores")
    discard(chunks, grams, summed)
    return scored


def op7_context_tree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    return score(docs, held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "code_length")
