"""Fill-in-middle: the checkpoint index against plain splitting, the forms against a plain version, round trips."""
import hashlib
import re

import numpy as np
import pytest

from chronotext.llm import infill

from . import cases

TEXTS = cases.TEXTS + ["\n", "\n\n\n", "a\nb", "a\nb\n", "äö\n\n東京\nend", "x<P>y\n", "<S", "S>\nb<\n", "\r\n\r\n", "line\n" * 3000, "é" * 5000 + "\n" + "z" * 5000]


def lines(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def expected(doc_id, text, units=lines, rate=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    u = units(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit,split", [("line", lines), ("char", list)])
@pytest.mark.parametrize("every,window,rescan", [(1, 7, 3), (3, 5, 2), (64, 1 << 20, 1 << 12)])
def test_checkpoints(monkeypatch, unit, split, every, window, rescan):
    monkeypatch.setattr(infill, "RESCAN", rescan)
    for text in TEXTS:
        text = (text or "")[:400]
        units = split(text)
        index = infill.Checkpoints(np.frombuffer(text.encode(), np.uint8), unit, every, window)
        assert (index.count, index.points, len(index.bytes)) == (len(units), len(text), -(-len(units) // every))
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert index.locate(k) == (len(head.encode()), len(head))


@pytest.mark.parametrize("unit,split", [("line", lines), ("char", list)])
def test_forms_and_round_trip(spark, unit, split):
    df = cases.frame(spark, TEXTS).repartition(3)
    made = infill.fill_in_middle(df, unit=unit)
    assert made.columns == [*df.columns, "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = made.withColumn("back", infill.restored()).collect()
    assert {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows} == {i: expected(i, t, split) for i, t in enumerate(TEXTS)}
    assert all(r.back == (r.text or "") for r in rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_rates(spark):
    df = cases.frame(spark, ["one\ntwo\nthree"] * 200)
    assert {r.form for r in infill.fill_in_middle(df, rate=0).collect()} == {"plain"}
    assert {r.form for r in infill.fill_in_middle(df, spm=100).collect()} == {"spm"}
    rows = infill.fill_in_middle(df, rate=30, spm=20).collect()
    assert {r.doc_id: r.output for r in rows} == {i: expected(i, "one\ntwo\nthree", rate=30, spm=20)[4] for i in range(200)}


def test_null_ids_repeats_empty_table_and_refusals(spark):
    df = spark.createDataFrame([(None, "a\nb", 1), (5, None, 2), (5, None, 2), (6, "", 3)], "id long, body string, output int")
    made = infill.fill_in_middle(df, "id", "body", keep=["id", "body"])
    assert sorted((str(r.id), r.n, r.form) for r in made.collect()) == [("5", 0, "plain"), ("5", 0, "plain"), ("6", 0, "plain"), ("None", 2, expected("", "a\nb")[1])]
    assert infill.fill_in_middle(df.limit(0), "id", "body", keep=["id"]).collect() == []
    with pytest.raises(ValueError):
        infill.fill_in_middle(df, "id", "body")
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "P>", "<M>"), ("ab", "bc", "xx"), ("aba", "x", "y"), ("", "x", "y")):
        with pytest.raises(ValueError):
            infill.check_marks(marks)
