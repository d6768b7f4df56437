"""SimHash, secrets, languages, mixing and the pipeline against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from lorewell.llm import language, mixing, secrets, simhash, stages
from lorewell.llm.components import components
from lorewell.llm.shared import tokenizer_path

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def naive_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(values, bits=4):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(values):
        for j in range(i):
            if (x ^ values[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def test_simhash_of_hard_rows(hard, none):
    rows = hard.collect()
    prints = [naive_fingerprint(r.text or "") for r in rows]
    roots = naive_components(prints)
    least = {}
    for r, c in zip(rows, roots):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    wanted = [(r.doc_id, format(p, "016x"), least.get(c)) for r, p, c in zip(rows, prints, roots)]
    got = [tuple(r) for r in simhash.simhash_components(hard).collect()]
    assert sorted(map(repr, wanted)) == sorted(map(repr, got))
    assert simhash.simhash_components(none).count() == 0


@pytest.mark.parametrize("slice_rows", [5, 4000])
def test_near_links_connect_what_all_pairs_connect(spark, slice_rows):
    draw = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(40):  # chains and clouds of near values
        x = draw.getrandbits(64)
        for _ in range(12):
            values.add(x)
            x ^= sum(1 << b for b in draw.sample(range(64), draw.randint(1, 5)))
    values = sorted(values)
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp bigint")
    links = simhash.near_links(simhash.written(frame, "fps"), 4, slice_rows)
    for u, v in links.collect():
        assert ((u ^ v) & ((1 << 64) - 1)).bit_count() <= 4
    found = {r.node: r.component for r in components(links).collect()}
    wanted = naive_components(values)
    groups, ours = {}, {}
    for v, c in zip(values, wanted):
        groups.setdefault(c, set()).add(v)
        ours.setdefault(found.get(simhash._signed(v), simhash._signed(v)), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_components_of_a_long_path(spark):
    links = spark.range(300).selectExpr("id + 1 AS u", "id AS v").repartition(4)
    assert {(r.node, r.component) for r in components(links).collect()} == {(i, 0) for i in range(301)}
    assert components(links.filter("u < 0")).count() == 0


def naive_base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def test_secrets_equal_a_plain_search(hard, none, documents):
    for docs in (hard, documents):
        got = [tuple(r) for r in secrets.scan_secrets(docs).drop("spans").collect()]
        wanted = []
        for r in docs.collect():
            spans = naive_base(r.text or "")
            joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
            counts = [sum(k == i for _, k, _ in spans) for i in range(3)]
            wanted.append((r.doc_id, *counts, hashlib.sha256(joined.encode()).hexdigest()))
        assert sorted(map(repr, got)) == sorted(map(repr, wanted))
    assert secrets.scan_secrets(none).count() == 0


def test_checksums_decide():
    body = "aB3" * 10
    good = f"ghp_{body}{secrets.checksum(body)}"
    assert secrets.find_secrets(f"x {good} y") == [(2, 3, 2 + len(good))]
    assert secrets.find_secrets(f"x ghp_{body}000000 y") == []
    assert secrets.redact(f"x {good} y token = {good}z") == f"x {secrets.MASK} y {secrets.MASK}"


def test_suffix_automaton_holds_exactly_the_substrings():
    text = b"abracadabra cad"
    moves = language.suffix_automaton(text)

    def holds(word):
        state = 0
        for byte in word:
            if byte not in moves[state]:
                return False
            state = moves[state][byte]
        return True

    for a in range(len(text)):
        for b in range(a + 1, len(text) + 1):
            assert holds(text[a:b])
    assert not holds(b"brad") and not holds(b"x")


def test_phrases_equal_a_plain_parse():
    references = (("a", b"the quick brown fox"), ("b", b"la maison de la reine"))
    parser = language.CrossParser(references)
    text = "the brown maison de qui? la fox" * 40
    for column, (_, known) in enumerate(references):
        phrases = 0
        data = text.encode()
        data = bytes(x if chr(x).isalpha() else 0x20 for x in data)
        for first in range(0, len(data), language.WIDTH):
            part, phrases, held = data[first : first + language.WIDTH], phrases + 1, b""
            for i in range(len(part)):
                if held + part[i : i + 1] in known:
                    held += part[i : i + 1]
                else:
                    phrases += 1
                    held = part[i : i + 1] if part[i : i + 1] in known else b""
        assert parser.bits_per_byte([text])[0, column] == pytest.approx(phrases * parser.bits[column] / len(data))


def test_languages(hard, none, spark):
    references = language.learn_references(hard)
    got = language.predict_languages(hard, references).collect()
    assert len(got) == hard.count()
    texts = {r.doc_id: r.text for r in hard.collect()}
    for r in got:
        text = texts[r.doc_id]
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text))
        assert 0 <= r.score <= 1
    assert language.predict_languages(none, references).count() == 0
    assert language.learn_references(none) == ()
    assert {r.lang_pred for r in language.predict_languages(hard, ()).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict_languages(docs, language.learn_references(docs)).filter("held_out")
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95


def naive_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while True:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]} if open_ else set()
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in full)
        open_ -= full


def test_mix_comes_near_its_targets(spark, hard, none, documents):
    for docs in (hard, documents):
        rows = mixing.mix_sources(mixing.document_sizes(docs)).collect()
        assert len(rows) == docs.count()
        sizes, taken = Counter(), Counter()
        for r in rows:
            sizes[r.source] += r.size
            taken[r.source] += r.size * r.copies
            assert 0 <= r.copies <= 3
        wanted = naive_targets(sizes)
        for r in rows:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
        again = mixing.mix_sources(mixing.document_sizes(docs.repartition(5))).collect()
        key = lambda r: repr((r.doc_id, r.source, r["size"], r.copies))
        assert sorted(map(key, rows)) == sorted(map(key, again))
        for s in wanted:  # few documents cannot meet every sum
            assert abs(taken[s] - wanted[s]) <= max(1, max(r["size"] for r in rows if r.source == s))
    assert mixing.mix_sources(mixing.document_sizes(none)).count() == 0


@pytest.mark.parametrize("table", [5, 1 << 16])
def test_budget_fitting_reaches_the_best_sum(table, monkeypatch):
    monkeypatch.setattr(mixing, "TABLE", table)
    draw = random.Random(table)
    for _ in range(100):
        lengths = np.array(sorted(draw.sample(range(1, 40), draw.randint(1, 6))))
        counts = np.array([draw.randint(1, 5) for _ in lengths])
        budget = draw.randint(0, int((lengths * counts).sum()))
        taken = mixing.fit_budget(lengths, counts, budget)
        assert (0 <= taken).all() and (taken <= counts).all()
        got = int((lengths * taken).sum())
        assert got <= budget and budget - got < lengths.max()


def test_stages_on_hard_rows(spark, hard, none):
    columns = stages.DOCUMENT
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, hard, "").columns == columns, name
        assert stage(spark, none, "").count() == 0, name
    assert stages.best_fit_packing(spark, none, "").count() == 0
    kept = stages.language_id(spark, hard, "").collect()
    letters = [r for r in hard.collect() if r.text and any(c.isalpha() for c in r.text)]
    assert sorted(repr(r.doc_id) for r in kept) == sorted(repr(r.doc_id) for r in letters)
    unique = stages.simhash_dedup(spark, hard, "").collect()
    roots = naive_components([naive_fingerprint(r.text or "") for r in hard.collect()])
    assert len(unique) == len(set(roots))
    masked = {r.doc_id: r for r in stages.secret_scan(spark, hard, "").collect()}
    for r in hard.collect():
        assert masked[r.doc_id].text == (r.text if r.text is None else secrets.redact(r.text))
        assert masked[r.doc_id].n_chars == (None if r.text is None else len(masked[r.doc_id].text))
    mixed = Counter(r.doc_id for r in stages.mix_sources(spark, hard, "").collect())
    copies = Counter()
    for r in mixing.mix_sources(mixing.document_sizes(hard.select(*columns).withColumn("row", mixing.F.lit(1)), "row")).collect():
        copies[r.doc_id] += r.copies
    assert mixed == +copies


def test_pipeline_equals_brute_force(spark, documents):
    """Every stage on what the one before it gave, done again row by row."""
    docs = documents
    seen = [[r.asDict() for r in docs.collect()]]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stages.written(stage(spark, docs, ""), "step")
        seen.append([r.asDict() for r in docs.collect()])
    known, unique, masked, mixed = seen[1:]
    assert {r["doc_id"] for r in known} == {
        r["doc_id"] for r in seen[0] if r["text"] and any(c.isalpha() for c in r["text"])
    }
    given = {r["doc_id"]: r for r in seen[0]}
    assert all(r | {"lang": given[r["doc_id"]]["lang"] or r["lang"]} == given[r["doc_id"]] | {"lang": r["lang"]} for r in known)
    roots = naive_components([naive_fingerprint(r["text"]) for r in known])
    least = {}
    for r, c in zip(known, roots):
        least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in unique) == sorted(least.values()) and len(unique) < len(known)
    texts = {r["doc_id"]: secrets.redact(r["text"]) for r in unique}
    assert {r["doc_id"]: r["text"] for r in masked} == texts
    sizes, wanted, copies = Counter(), Counter(), Counter(r["doc_id"] for r in mixed)
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in masked}
    for r in masked:
        sizes[r["source"]] += words[r["doc_id"]]
        wanted[r["source"]] += words[r["doc_id"]] * copies[r["doc_id"]]
    assert max(copies.values()) <= 3
    for s, target in naive_targets(sizes).items():
        assert abs(wanted[s] - target) <= max(1, max(words[r["doc_id"]] for r in masked if r["source"] == s))
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces = []
    for r in mixed:
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        pieces += [(r["doc_id"], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
                   for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(pieces)
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        ends = [0, *(a + n for a, n in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048
