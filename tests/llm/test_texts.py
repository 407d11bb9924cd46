"""Decontamination, packing, scoring, chats, quality, toxicity, token counts and audio."""
import collections
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.llm import audio, chat, decontaminate, packing, quality, rollup, scoring, toxicity

from . import cases

DATA = "/root/testdata/sf0.001"


def words(t):
    import re
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", cases.bytes_of(t).translate(cases.LOWER))


@pytest.mark.parametrize("block", [100_000, 20])
def test_decontaminate_scan(spark, block):
    items = ["One", "alpha beta", " ".join(f"w{i}" for i in range(14)), cases.PASSAGE[:200], "", None, "x y z x y z x y z x y", "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"]
    r = random.Random(5)
    texts = cases.TEXTS + [" ".join(f"W{i}" for i in range(r.randrange(8), r.randrange(9, 20))) + " x y z" * r.randrange(6) for _ in range(30)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {int(x.id): x for x in decontaminate.scan(cases.frame(spark, texts), bench, block_words=block).collect()}
    windows = collections.defaultdict(set)
    for name, t in enumerate(items):
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(name))
    for i, t in enumerate(texts):
        w, hit, names = words(t), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if (key := tuple(w[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    names |= windows[key]
        assert got[i].n_words == len(w) and sum(s.last - s.first for s in got[i].spans) == len(hit) and got[i]["items"] == sorted(names), (i, t)


def test_decontaminate_removes(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    inside = "start of it " * 10 + " ".join(f"W{i}," for i in range(12)) + " the end"
    df = cases.frame(spark, [inside, " ".join(f"w{i}" for i in range(12)), "clean", None])
    out = {r.doc_id: r.text for r in decontaminate.decontaminate(df, bench).collect()}
    assert out == {0: "start of it " * 10 + ", the end", 2: "clean", 3: None}
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == 4 and decontaminate.scan(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("block", [100_000, 20])
def test_decontaminate_does_not_depend_on_blocks(spark, block):
    """Texts and repeated or null ids against windows found one by one in the whole text."""
    a, b, c = ([f"{x}{i}" for i in range(20)] for x in "abc")
    clean = [f"n{i}" for i in range(100)]
    items = [(None, " ".join(a)), (2, " ".join(a[10:] + b[:10])), (3, " ".join(b)), (3, " ".join(c[:12])), (5, "lone"), (6, " ".join(c[:5] + c[14:]))]
    texts = [" ".join(clean[:30] + a + b[:10] + clean[30:50]), " ".join(clean[:20] + a + clean[20:24] + b + clean[24:28]), ", ".join(c[:5] + c[:12] + c[14:] + clean), "; ".join(a + b + clean[:60]), " ".join(a[:16]), " ; ".join(a + c[:12] + clean[:60]), "x lone y z", None, "", "clean text"]
    rows = [(i, t, "en", 7, "x") for i, t in enumerate(texts)] + [(None, t, None, 1, "y") for t in texts] + [(1, texts[0], "de", 2, "z")] * 2
    windows = {tuple(w[k : k + 10]) for w in (words(t) for _, t in items) for k in range(max(1, len(w) - 9))}
    expected, hits_of = [], []
    for r in rows:
        data = cases.bytes_of(r[1])
        at = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", data)]
        w, hit = words(r[1]), set()
        for size in (1, 10, 11, 12):
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
        hits_of.append((None if r[0] is None else str(r[0]), len(w), len(hit)))
        gone = bytearray(len(data))
        for k in hit:
            gone[at[k][0] : (at[k + 1][0] if k + 1 in hit else at[k][1])] = b"\1" * ((at[k + 1][0] if k + 1 in hit else at[k][1]) - at[k][0])
        if len(hit) <= 0.5 * len(w):
            expected.append((r[0], None if r[1] is None else bytes(x for x, g in zip(data, gone) if not g).decode(), *r[2:]))
    docs, bench = spark.createDataFrame(rows, cases.COLUMNS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench, block_words=block)
    assert got.columns == docs.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    scanned = [(r.id, r.n_words, sum(s.last - s.first for s in r.spans)) for r in decontaminate.scan(docs, bench, block_words=block).collect()]
    assert sorted(map(repr, scanned)) == sorted(map(repr, hits_of))


def test_packing(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = cases.TEXTS + ["<|endoftext|> don't <|startoftext|>x", "ÀÉ é İ Σς 123,456!! a_b", "İZMİR, KAYSERİ. ANKARALİ, dedi", "क़, ड़. ख़! שׁ, 가, ﬁ. ǰ? ẗ; ŉ, ΐ."]
    df = cases.frame(spark, texts)
    pieces = packing.token_pieces(df, capacity=256)
    packed = packing.pack_pieces(pieces, 256).collect()
    by_doc = collections.defaultdict(list)
    for p in packed:
        by_doc[p.doc_id].append(p)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        parts = sorted(by_doc[i], key=lambda p: p.start)
        assert [x for p in parts for x in p["ids"]] == ids and all(p.doc_tokens == len(ids) for p in parts)
    by_sequence = collections.defaultdict(list)
    for p in packed:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    whole = packing.sequences(packing.pack_pieces(pieces, 256), 256).collect()
    assert sum(s.n_tokens for s in whole) == sum(p.length for p in packed)
    assert all(len(s.ids) == 256 or bin(s.n_tokens).count("1") == 1 for s in whole)
    assert packing.pack_pieces(packing.token_pieces(df.limit(0))).count() == 0


def test_words_with_signs_encode_as_the_tokenizer_does():
    from tokenizers import Tokenizer
    with open(packing.default_tokenizer(), encoding="utf-8") as file:
        settings = file.read()
    tokenizer, cache = Tokenizer.from_str(settings), packing.WordCache(settings)
    assert cache.apart
    letters = [chr(c) for c in range(0x80, 0x30000) if chr(c).isalpha() and (len(chr(c).lower()) > 1 or unicodedata.normalize("NFC", chr(c)) != chr(c) or c % 97 == 0)]
    r = random.Random(8)
    words = [f"{x}{sign}" for x in letters for sign in (",", ".\"")] + ["".join(r.choices([*letters, "İ", "a", "B"], k=r.randrange(1, 5))) + r.choice([",", "!?", "...", "-", ""]) for _ in range(3000)]
    for word in words:
        assert cache.encode(word.encode()) == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(word, add_special_tokens=False).ids), word


def test_pack_histogram():
    counts = {3: 5, 5: 2, 8: 1, 1: 9}
    patterns = packing.pack_histogram(counts, 8)
    total = collections.Counter()
    for c, lengths in patterns:
        assert sum(lengths) <= 8
        for x in lengths:
            total[x] += c
    assert total == counts


def test_context_tree(spark):
    texts = cases.TEXTS[:13]
    df = cases.frame(spark, texts)
    got = {r.doc_id: r for r in scoring.score(df, F.col("doc_id") % 4 == 1).collect()}
    rows = [scoring.normalised(cases.bytes_of(t)) for t in texts]
    train = [r for i, r in enumerate(rows) if i % 4 != 1]
    counts = collections.Counter(w for r in train for w in [*r.split(), b""])
    n, v = sum(counts.values()), len(counts)
    nodes = {}
    for data in train:
        data = scoring.PAD + data + b"\xff"
        for p in range(scoring.DEPTH, len(data)):
            for d in range(scoring.DEPTH + 1):
                node = 1
                for j in range(7, -1, -1):
                    bit = data[p] >> j & 1
                    nodes.setdefault((data[p - d : p], node), [0, 0])[bit] += 1
                    node = 2 * node + bit
    log, weight = {}, {}
    children = collections.defaultdict(list)
    for c, node in nodes:
        if c:
            children[c[1:], node].append((c, node))
    for key in sorted(nodes, key=lambda k: -len(k[0])):
        a, b = nodes[key]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        below = sum(log[c] for c in children[key])
        top = max(own, below)
        log[key] = own if len(key[0]) == scoring.DEPTH else top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(below - top))
        weight[key] = 1.0 if len(key[0]) == scoring.DEPTH else math.exp(math.log(0.5) + own - log[key])
    for i, text in enumerate(rows):
        data, total = scoring.PAD + text + b"\xff", 0.0
        for p in range(scoring.DEPTH, len(data)):
            node = 1
            for j in range(7, -1, -1):
                bit, estimate = data[p] >> j & 1, None
                path = []
                for d in range(scoring.DEPTH + 1):
                    if (data[p - d : p], node) not in nodes:
                        break
                    path.append((data[p - d : p], node))
                for key in path[::-1]:
                    own = (nodes[key][bit] + 0.5) / (sum(nodes[key]) + 1)
                    estimate = own if estimate is None else weight[key] * own + (1 - weight[key]) * estimate
                total += math.log10(0.5 if estimate is None else estimate)
                node = 2 * node + bit
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*text.split(), b""])
        r = got[i]
        assert math.isclose(r.score, total, rel_tol=1e-9) and math.isclose(r.base_score, base, rel_tol=1e-9) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(text.split()) + 1, sum(counts[w] > 0 for w in [*text.split(), b""]))
    assert scoring.score(df.limit(0), F.lit(False)).count() == 0


def test_scoring_probabilities_sum_to_one(spark):
    """Over all bytes that may follow a context."""
    keys = np.arange(256, dtype=np.int64) | 0x6162636400
    counts = np.zeros(256, dtype=np.int64)
    counts[[0x61, 0x62]] = 5, 2
    shallow = scoring.shallow_nodes([(0x64, 0x61, 5), (0x64, 0x62, 2)], [(0x64, k, 0.0) for k in range(256)])
    import pyarrow as pa
    broadcast = type("B", (), {"value": shallow})
    values = scoring._gram_values(broadcast)(pa.table({"bucket": keys * 0, "key": keys, "n": counts})).column("value").to_numpy()
    assert abs((10**values).sum() - 1) < 1e-9


def test_chat_round_trip(spark):
    for text in ("", "</s>[INST] ok [/INST]", "<|end|>\n<|user|>\nhi", "&a;&l;&amp;<|", "<</s>[[/INST]<s><|>", "a & b <| c |> d"):
        formatted, loss = chat.render([("user", text), ("assistant", text), ("odd|>role<|", text)])
        assert chat.parse(formatted) == [("user", text), ("assistant", text), ("odd|>role<|", text)]
        assert [chat.unescape(formatted[a:b]) for a, b in loss] == [text]


def test_chat_events(spark):
    rows = [(1, 1, "message", "a", "user", "hi"), (1, 2, "delta", "b", "assistant", "he"), (1, 3, "delta", "b", None, "llo"), (1, 4, "message", "c", "user", "more"), (1, 5, "regenerate", "b", None, None),
            (1, 6, "delta", "b", None, "bye"), (1, 7, "edit", "a", None, "hey"), (2, 1, "message", "x", "user", "gone"), (2, 2, "delete", "x", None, None), (3, 1, None, None, None, None)]
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message string, role string, text string")
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_chats(events.repartition(3)).collect()}
    assert got == {1: [("user", "hey"), ("assistant", "bye")], 3: [("", "")]}
    assert chat.format_chats(events.limit(0)).count() == 0


def test_chat_draft_log(spark):
    rows = [(1, 2, "assistant", "héllo <s>[INST] & &l;", 1), (1, 1, "user", "</s>", 2), (1, 3, "assistant", None, 3), (1, 3, "assistant", None, 3), (1, 4, None, "x", 4), (None, 1, "assistant", "a", 5), (None, None, "user", "b", 6)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place long")
    log = chat.draft_log(turns)
    assert {r.kind for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    got = {r.conv_id: (chat.parse(r.formatted), r.formatted) for r in chat.format_chats(log.repartition(5)).collect()}
    assert got[1][0] == [("user", "</s>"), ("assistant", rows[0][3]), ("assistant", ""), ("assistant", ""), ("", "x")]
    assert got[None][0] == [("user", "b"), ("assistant", "a")]
    assert not any(c in got[1][1] for c in chat.CONTROLS if c != "<|")
    assert chat.format_chats(chat.draft_log(turns.limit(0))).count() == 0


def test_chat_fold_against_plain_lists():
    import random
    draw = random.Random(3)

    def plain(events):
        out = []
        for kind, message, role, text in events:
            at = next((i for i, m in enumerate(out) if m[0] == message), None)
            if kind == "delete":
                out = [m for m in out if m[0] != message]
            elif at is None:
                out.append([message, role, text])
            elif kind == "regenerate":
                out = out[: at + 1]
                out[at][2] = text
            elif kind == "delta":
                out[at][2] += text
            else:
                out[at][1:] = [role or out[at][1], text]
        return [(r, t) for _, r, t in out]
    for _ in range(500):
        events = [(draw.choice(["message", "delta", "edit", "regenerate", "delete"]), draw.choice("abcd"), draw.choice(["", "user", "assistant"]), draw.choice(["", "x", "yz"])) for _ in range(draw.randrange(30))]
        assert chat.fold(events) == plain(events)


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    made = quality.profiles(docs)
    out = quality.score(made, quality.fit(made)).join(labels, "doc_id")
    good = out.where("quality = 1").agg(F.avg((F.col("score") >= 0.5).cast("int"))).first()[0]
    bad = out.where("quality = 0").agg(F.avg((F.col("score") < 0.5).cast("int"))).first()[0]
    assert good >= 0.98 and bad >= 0.75
    df = cases.frame(spark, cases.TEXTS)
    assert quality.keep(df).columns == df.columns and quality.keep(df.limit(0)).count() == 0


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/../sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(toxicity.remainder("doc_id") != 0))
    held = toxicity.score(docs, model).where(toxicity.remainder("doc_id") == 0).join(labels, "doc_id")
    caught = held.where("toxic = 1").agg(F.avg((F.col("score") >= 0.5).cast("int"))).first()[0]
    wrong = held.where("toxic = 0").agg(F.avg((F.col("score") >= 0.5).cast("int"))).first()[0]
    assert caught >= 0.85 and wrong <= 0.02
    scores = toxicity.score(cases.frame(spark, cases.TEXTS), model).collect()
    assert len(scores) == len(cases.TEXTS) and all(0 <= r.score <= 1 for r in scores)
    empty = toxicity.fit(docs.limit(0), labels.limit(0))
    assert 0 < toxicity.score(cases.frame(spark, ["x"]), empty).first().score < 1


def test_toxic_folding():
    assert toxicity.fold("1D10T") == toxicity.fold("idiot") == toxicity.fold("іdіоt") == toxicity.fold("ïdïöt")
    scorer = toxicity.Scorer({toxicity.fold("moron").strip(): 2.0}, [toxicity.fold("the moron").strip()])
    assert scorer("a m0r0n!")[0] == 2.0 and scorer("the moron")[0] == 0.0 and scorer("oxymoron")[0] == 0.0 and scorer("")[0] == 0.0


def test_rollup(spark, tmp_path):
    schema = "source string, lang string, tokenizer string, tokens long, new_tokens long"
    rows = spark.createDataFrame([("a", "en", "t", 5, 7), ("a", "en", "t", 5, 7), (None, None, "t", None, None)], schema)
    path = str(tmp_path / "rollup")
    rollup.commit(path, 1, rollup.inserts(rows))
    rollup.commit(path, 2, rollup.revisions(rows.limit(1)))
    rollup.commit(path, 2, rollup.revisions(rows.limit(1)))
    assert sorted(map(tuple, rollup.totals(spark, path).collect()), key=repr) == sorted([("a", "en", "t", 2, 12), (None, None, "t", 1, 0)], key=repr)
    rollup.commit(path, 3, rollup.deletes(rows.where("source is null")))
    rollup.commit(path, 4, rollup.inserts(rows.limit(0)))
    assert rollup.totals(spark, path).count() == 1
    before = sorted(rollup.totals(spark, path).collect())
    with pytest.raises(Exception):  # an attempt that fails while it runs, and one that is lost before its commit
        rollup.commit(path, 2, rollup.inserts(rows.withColumn("tokens", F.raise_error(F.lit("lost")).cast("long"))))
    rollup.inserts(rows).write.parquet(f"{path}/batches/lost")
    assert sorted(rollup.totals(spark, path).collect()) == before
    read = rollup.totals(spark, path)
    rollup.commit(path, 2, rollup.revisions(rows.limit(1).withColumn("new_tokens", F.lit(105).cast("long"))))
    assert sorted(read.collect()) == before and sorted(map(tuple, rollup.totals(spark, path).collect())) == [("a", "en", "t", 2, 110)]
    rollup.sweep(spark, path)
    assert sorted(map(tuple, rollup.totals(spark, path).collect())) == [("a", "en", "t", 2, 110)] and len(list((tmp_path / "rollup" / "batches").iterdir())) == 4
    assert rollup.totals(spark, str(tmp_path / "none")).count() == 0
    clash = rows.withColumns({"documents": F.lit("x"), "batch_id": F.lit(9)})
    rollup.commit(path, 5, rollup.inserts(clash))
    assert rollup.totals(spark, path).where("source = 'a'").first().documents == 4


def test_fingerprints(spark):
    r = np.random.default_rng(6)
    t = np.arange(20_000)
    tune = np.concatenate([np.sin(2 * np.pi * f * t[:2000] / audio.RATE) for f in r.choice([220, 262, 330, 392, 440, 523], 10)])
    clean = (128 + 90 * tune + r.normal(0, 2, len(tune))).clip(0, 255).astype(np.uint8)
    late, other = clean[audio.HOP * 50 :], r.integers(0, 255, 12_000).astype(np.uint8)
    noisy = (clean.astype(int) + r.integers(-2, 3, len(clean))).clip(0, 255).astype(np.uint8)
    rows = [(1, clean.tobytes()), (2, late.tobytes()), (3, other.tobytes()), (4, clean.tobytes()), (5, None), (6, b""), (7, noisy.tobytes())]
    made = audio.fingerprints(spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "doc_id long, text binary")).cache()
    by = {x.id: x for x in made.collect()}
    assert by[1]["class"] == by[4]["class"] and by[5].n_items == by[6].n_items == 0
    assert by[1].n_items == (len(clean) - audio.FRAME) // audio.HOP + 1 - audio.WIDTH + 1
    classes = made.where("n_items > 0").dropDuplicates(["class"])
    found = audio.align(classes, classes.where(F.col("id").isin(1, 4)))
    names = {x["class"]: x.id for x in made.collect()}
    got = {names[x["class"]]: x for x in found.collect()}
    assert set(got) == {2, 7} and got[2].offset == -50 and got[2].bit_errors == 0 and got[7].offset == 0


def test_alignments_of_parts(spark):
    """An excerpt in the middle of other sound, a loop's second offset, and copies that are too short for integers."""
    r = np.random.default_rng(8)
    noise = lambda n: r.integers(0, 255, audio.HOP * n).astype(np.uint8)
    theme = noise(60)
    rows = [(1, np.concatenate([noise(100), theme, noise(100)])), (2, np.concatenate([noise(150), theme, noise(90)])), (3, np.concatenate([theme, noise(40), theme[: audio.HOP * 45]])),
            (4, theme[audio.HOP * 15 :]), (5, noise(3)), (7, noise(4)), (8, theme[:0])]
    rows = [(i, bytearray(x.tobytes())) for i, x in rows] + [(9, None), (10, None)]
    rows += [(6, rows[4][1])]
    made = audio.fingerprints(spark.createDataFrame(rows, "doc_id long, text binary")).cache()
    by = {x.id: x["class"] for x in made.collect()}
    assert by[5] == by[6] and len({by[i] for i in (5, 7, 8, 9, 10)}) == 5
    classes = made.where("n_items > 0")
    names = {x: i for i, x in by.items()}
    found = {(names[x["class"]], y.offset): y for x in audio.align(classes, classes.where("id = 1")).collect() for y in (x, *x.others)}
    assert (2, 50) in found and {(3, -100), (4, -115)} <= set(found)
    part = found[2, 50]
    # Filters look at WIDTH frames, and a frame at FRAME samples: the whole of the theme less what reaches beyond it.
    inside = (len(theme) - audio.FRAME) // audio.HOP + 1 - audio.WIDTH + 1
    assert part.bit_errors > 0.2 * 32 * part.overlap and part.stretch_errors <= 0.2 * 32 * part.length
    assert part.start <= 100 and part.start + part.length >= 100 + inside
    assert audio.align(classes, classes.where("id = 5")).count() == 0


def test_second_offset():
    """A shared part that most votes don't speak for is still tested."""
    r = np.random.default_rng(9)
    a, b, other, more = (r.integers(0, 1 << 32, n).astype("<u4") for n in (30, 20, 25, 25))
    q, c = np.concatenate([a, other, b]), np.concatenate([b, a, more])
    import pyarrow as pa
    kinds = pa.list_(pa.struct([("offset", pa.int64()), ("votes", pa.int64())]))
    pair = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([[{"offset": 20, "votes": 30}, {"offset": -55, "votes": 20}, {"offset": 3, "votes": 3}]], kinds), pa.array([q.tobytes()]), pa.array([c.tobytes()])], names=["query", "class", "offsets", "q", "r"])
    (got,) = next(audio._alignments([pair])).to_pylist()
    assert [(x["offset"], x["start"], x["length"], x["stretch_errors"]) for x in (got, *got["others"])] == [(20, 0, 30, 0), (-55, 55, 20, 0)]


def test_integral_image():
    """A filter's value against sums taken one by one."""
    r = np.random.default_rng(7)
    picture = r.random((40, 12))
    image = np.zeros((41, 13))
    image[1:, 1:] = picture.cumsum(axis=0).cumsum(axis=1)
    got = audio.Fingerprinter.apply(image, 25, 2, 3, 4, 8)
    for k in range(25):
        early, late = picture[k : k + 4, 3:7].sum(), picture[k + 4 : k + 8, 3:7].sum()
        assert math.isclose(got[k], math.log1p(early) - math.log1p(late), abs_tol=1e-9)


def test_fingerprints_do_not_depend_on_neighbours():
    make = audio.Fingerprinter()
    for recording in (b"abcdefgh" * 500, b"ab " * 1500, b"x" * 4000):
        alone = make.items(np.frombuffer(recording, np.uint8), np.array([0, len(recording)]))[0]
        for k in range(5):
            before = bytes((i * 7919 * (k + 1) + i // 3) % 97 + 25 for i in range(3000 + 71 * k))
            both = make.items(np.frombuffer(before + recording, np.uint8), np.array([0, len(before), len(before) + len(recording)]))
            assert both[1].tolist() == alone.tolist()
