"""Tokens: pre-tokens, packing, files and counts against the library and brute force."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lorewell.llm import language, packing, pretokens, token_files
from lorewell.llm.pretokens import PretokenIds
from lorewell.llm.shared import tokenizer_path
from lorewell.llm.token_counts import count_tokens
from lorewell.llm.token_files import SequenceReader, read_token_files, write_token_files

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_equal_the_library(path):
    library = Tokenizer.from_file(path)
    texts = ["", " ", "it's 'self ''s !'s \n's \t 't", "a  b \n\n c   ", "ΣΑΣ İ ﬁ ǅ", "'s's'll're've'd'm't's",
             "don't I'LL", "\x00a\x00 \x1c b", "🙂 ok 'r 'l 'v", "  's  'll", "aᲉb", "x" * 300]
    texts += [f"a{chr(c)}b 1{chr(c)}2 .{chr(c)}. {chr(c)}'s" for c in range(1, 0x2100)]
    ours = PretokenIds(path, cached=500).encode(texts)
    for text, ids in zip(texts, ours):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def check_packing(docs, capacity):
    library = Tokenizer.from_file(BYTES)
    got = [r.asDict() for r in packing.pack_documents(docs, BYTES, capacity).collect()]
    wanted = []
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        head = len(ids) % capacity or capacity
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        wanted += [(r.doc_id, i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r[k] for k in key)) for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r["length"] for r in got)


def test_packing_of_hard_rows(hard, none):
    check_packing(hard, 2048)
    check_packing(hard, 64)
    assert packing.pack_documents(none, BYTES).count() == 0


def test_packing_is_tight_over_many_partitions(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_PART", 20)  # sweeps cross partitions
    n, total = check_packing(documents, 2048)
    assert n <= 1.03 * total / 2048 + 1


def test_packing_of_ties(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_PART", 50)
    items = spark.range(400).selectExpr("id AS item", "bigint(CASE WHEN id < 300 THEN 500 ELSE 1 END) AS size")
    rows = packing.best_fit(packing.written(items, "items"), 2048).collect()
    assert len(rows) == 400 and len({r.sequence_id for r in rows}) == 75


def test_brackets_across_partitions():
    ranges = packing._across({0: (2, 3), 1: (2, 0), 2: (4, 1), 3: (1, 0)})
    assert ranges["document"] == [(1, 0, 2, 0), (2, 0, 1, 2), (3, 0, 1, 3)]
    assert ranges["gap"] == [(0, 0, 2, 0), (0, 2, 1, 2), (2, 0, 1, 3)]


@pytest.mark.parametrize("length, rows", [(2048, 64), (7, 3)])
def test_files_give_the_ids_back(spark, hard, none, tmp_path, length, rows):
    library, root = Tokenizer.from_file(WORDS), f"file://{tmp_path}"
    manifest = write_token_files(hard, WORDS, root, length=length, rows=rows)
    got = sorted(read_token_files(manifest, root).collect(), key=lambda r: r.start)
    texts = {r.doc_id: r.text or "" for r in hard.collect()}
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in hard.collect()), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, token_files.END]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    first = manifest.orderBy("part").first()
    ids, mask = SequenceReader(f"{root}/{first.name}.ids.arrow").sequence(0)
    assert len(ids) == len(mask) == length and mask.sum() == min(length, first.tokens)
    empty = write_token_files(none, WORDS, root)
    assert empty.count() == 0 and read_token_files(empty, root).count() == 0


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_counts_equal_the_library(hard, none, path):
    library = Tokenizer.from_file(path)
    got = count_tokens(hard, path).collect()
    wanted = []
    for r in hard.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        wanted.append((r.doc_id, len((r.text or "").encode()), n, n > 1024))
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in got)
    assert count_tokens(none, path).count() == 0


def test_packing_drops_the_models_of_stages_before(spark, monkeypatch):
    class Seen(Exception):
        pass

    def first_step(df, run, schema):
        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a dog"]})
        assert len(list(run(iter([batch])))) == 1
        raise Seen

    language.parser((("en", b"the dog and the cat"),))
    monkeypatch.setattr(packing, "map_batches", first_step)
    docs = spark.createDataFrame([(1, "a dog")], "doc_id long, text string")
    with pytest.raises(Seen):
        packing.document_pieces(docs, tokenizer_path("byte_bpe_50k.json"))
    assert language.parser.cache_info().currsize == 0
    assert pretokens.encoder.cache_info().currsize == 1
