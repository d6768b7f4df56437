"""License scans against a plain search and their SQL."""

import random
import re

import duckdb
import numpy as np
import pytest

from lorewell.llm import licenses as L

HARD = "doc_id bigint, text string, labels string, n_words int, word string, n int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, known):
    """Every start of every template, tried one by one."""
    texts = [words_of(r[1]) for r in rows]
    bits = {w: ((len(rows) + 1) // (sum(w in t for t in map(set, texts)) + 1)).bit_length() for w in L.vocabulary(known)}
    out = []
    for row, ws in zip(rows, texts):
        base, labels, score = [], set(), 0.0
        for t in known:
            whole = sum(bits[w] for w in t.words)
            for s in range(-len(t.words), len(ws)):
                there = [0 <= s + j < len(ws) and ws[s + j] == w for j, w in enumerate(t.words)]
                mass = sum(bits[w] for w, ok in zip(t.words, there) if ok)
                if all(there[slice(*t.key)]) and mass * 100 >= L.SHARE * whole:
                    labels.add(t.label)
                    score = max(score, mass / whole)
                    base += [(s, t.label)] * t.base
        starts = [s for s, _ in base]
        out.append((
            row[0], len(ws), len(base), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score,
        ))
    return sorted(out, key=repr)


def texts():
    draw = random.Random(2)
    out = [
        None, "", " \t", "the", "CC BY", "cc-by", "cc by by cc by", "ccby cc  BYE", "All Rights. Reserved!",
        "é ccé by", "Licensed under CC BY-NC 4.0.", "x Released under the MIT License. y", "MIT License",
        "This work is licensed under the GNU General Public License, version 3.", "general public license " * 50,
        "All rights", "reserved all rights reserved", "licensed under the apache license version 2 0" + " w" * 50_000,
        "Permission is hereby granted, free of charge, to some person obtaining a copy of that software",
    ]
    pool = sorted({w for t in L.templates() for w in t.words} | {"zz", "é", "İ", "MIT"})
    for _ in range(300):
        t = draw.choice(L.templates()).words
        own = [w if draw.random() < 0.85 else draw.choice(pool) for w in t[draw.randrange(2) :]]
        own = [draw.choice(pool) for _ in range(draw.randrange(4))] + own + [draw.choice(pool)] * draw.randrange(3)
        out.append(draw.choice([" ", "-", ".\n"]).join(w.upper() if draw.random() < 0.2 else w for w in own))
    return out


def test_hard_rows(spark, tmp_path):
    rows = [(i * 2, t, "x", 1, "w", 5) for i, t in enumerate(texts())]
    rows += [rows[10]] * 3 + [(None, "cc by", None, None, None, None), (None, None, None, None, None, None)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, HARD).repartition(3).write.parquet(path)
    got = sorted((tuple(r) for r in L.op12_license_scan(spark, str(tmp_path)).collect()), key=repr)
    assert got == plain(rows, L.templates())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(db.execute(L.OP12_SQL).fetchall(), key=repr) == got
    assert L.scan_licenses(spark.read.parquet(path).filter("doc_id = -5")).count() == 0


def test_own_templates_and_places(spark):
    known = [
        L.Template("x", False, ("a", "b", "a", "c"), (1, 3)),
        L.Template("y", True, ("b",), (0, 1)),
    ]
    rows = [(1, "a b a c b a", "", 1, "", 1), (2, "b a", "", 1, "", 1), (3, "c", "", 1, "", 1)]
    got = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(rows, HARD), known).collect()}
    assert got[1].places == "x:0:4,y:1:2,y:4:5"  # the second `b a` lacks too much of the notice
    wanted = plain(rows, known)
    assert sorted((tuple(r)[:-1] for r in got.values()), key=repr) == wanted


def test_codes_tell_words_apart():
    coder = L.WordCodes(["a", "ab", "license", "redistribution"])
    codes, first = coder.code(["A ab abc", "", "LICENSE-license licens redistribution redistributionx", "é"])
    assert codes.tolist() == [0, 1, -1, 2, 2, -1, 3, -1, -1] and first.tolist() == [0, 3, 3, 8, 9]
    assert coder.code([""])[0].tolist() == []
    with pytest.raises(ValueError):
        L.WordCodes(["seventeen letters".replace(" ", "") + "x"])


def test_rarity():
    assert L.rarity(7, [7, 3, 0]) == [1, 2, 4]
    assert np.all(np.diff(L.rarity(10**12, range(0, 10**6, 10**4))) <= 0)
