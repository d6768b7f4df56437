"""Fill-in-middle: ranks and cuts against plain counting, the whole operator against a plain one."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from lorewell.llm import infilling as I

SF = "/root/testdata/sf0.001"
HARD = "doc_id bigint, text string, n bigint, form string, output string, h1 int"


def test_rank_and_place_equal_counting():
    draw = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        values = draw.integers(0, 16, size).astype(np.uint8)
        matrix = I.WaveletMatrix(values)
        low = draw.integers(0, size + 1, 50)
        high = draw.integers(0, size + 1, 50)
        low, high = np.minimum(low, high), np.maximum(low, high)
        for wanted in ((3,), (0, 15), (1, 3, 5, 7), tuple(range(16))):
            plain = [int(np.isin(values[a:b], wanted).sum()) for a, b in zip(low, high)]
            assert matrix.rank(wanted, low, high).tolist() == plain
            units = np.array([draw.integers(0, n + 1) for n in plain])
            places = I.place_of(matrix, wanted, low, high, units)
            for a, b, n, at in zip(low, high, units, places):
                best = [p for p in range(a, b + 1) if np.isin(values[a:p], wanted).sum() <= n]
                assert at == (a if n == 0 else best[-1])


@pytest.mark.parametrize("unit, pattern", [
    ("char", r"(?s)."), ("word", r"[^\W_]+|[^\s\w]|_"), ("line", r"(?m)^(?s:.)"),
])
def test_units(unit, pattern):
    texts = ["", "one two  three", "a\nb\n\nc d", "\n\n", "ünï, 12 日本", " x ", "é z"]
    draws = np.array([[7, 3]] * len(texts))
    units, places = I.cuts(texts, draws, unit)
    for text, n, (a, b) in zip(texts, units.tolist(), places.tolist()):
        found = [m.start() for m in re.finditer(pattern, text)]
        if unit == "line":
            found = [i for i in range(len(text)) if i == 0 or text[i - 1] == "\n"]
        elif unit == "word":
            found = [i for i, c in enumerate(text) if not c.isspace() and (
                not c.isalnum() or i == 0 or not text[i - 1].isalnum())]
        assert n == len(found)
        at = [0 if k == 0 else len(text) if k == n else found[k] for k in sorted((7 % (n + 1), 3 % (n + 1)))]
        assert [a, b] == at


def plain(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, sha(f"<S>{suf}<P>{pre}<M>{mid}"), sha(text)
    return doc_id, n, "psm", a, b - a, sha(f"<P>{pre}<S>{suf}<M>{mid}"), sha(text)


def test_hard_rows(spark, tmp_path):
    draw = random.Random(3)
    texts = [None, "", " ", "\n", "x", "<P>", "a<S>b", "a <M", "<P<", ">M>", "日本語テキスト\U0001f600 é",
             "z" * 300_000, "  \x85 \x00", "same", "same"]
    texts += ["".join(draw.choice("ab<>PSM é\U0001f600\n") for _ in range(draw.randrange(40))) for _ in range(300)]
    rows = [(i, t, 1, "f", "o", 2) for i, t in enumerate(texts)]
    rows += [rows[4]] * 2 + [(None, "no name", 1, None, None, None), (None, None, None, None, None, None)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, HARD).repartition(3).write.parquet(path)
    got = sorted((tuple(r) for r in I.op11_fill_in_middle(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((plain(r[0], r[1]) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(db.execute(I.OP11_SQL).fetchall(), key=repr) == got
    empty = spark.read.parquet(path).filter("doc_id = -5")
    assert I.fill_in_middle(empty).count() == 0


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_texts_come_back(spark, unit):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = I.fill_in_middle(docs, unit, seed="9").withColumn(
        "back", I.restored(I.F.col("output"), I.F.col("form"))
    )
    met = rows.join(docs, "doc_id")
    assert met.filter("back <=> coalesce(text, '')").count() == docs.count()
    assert rows.filter("form <> 'plain'").count() > 0
