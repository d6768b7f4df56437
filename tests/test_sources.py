"""Files written and read back: values, order and bytes."""

import glob
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from lorewell.sources import assertions as S
from lorewell.sources import dialogs as D

RAW = [
    '/a/1\t/r/IsA\t/c/en/dog\t/c/en/pet\t{"weight": 2.0, "surfaceText": "[[a \\"dog\\"]], ok"}',
    '/a/2\t/r/IsA\t/c/en/"x\t/c/en/y\t{"weight": 1.0}',
]


def test_assertions_plain_and_gzip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join(RAW) + "\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("\n".join(RAW) + "\n")
    for name in ("a.csv", "b.csv.gz"):
        rows = S.read_assertions(spark, str(tmp_path / name), numbered=True).orderBy("line_no").collect()
        assert [r["line_no"] for r in rows] == [1, 2]
        assert [r["extra"] for r in rows] == [line.split("\t")[4] for line in RAW]
        assert rows[1]["start_uri"] == '/c/en/"x'


def test_edges_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join(RAW) + "\n")
    edges = S.read_assertions(spark, str(tmp_path / "a.csv")).withColumn("weight", F.lit(1.5))
    expected = sorted(map(tuple, edges.collect()))
    for fmt in ("csv", "parquet"):
        S.write_edges(edges, str(tmp_path / fmt), fmt)
        assert sorted(map(tuple, S.read_edges(spark, str(tmp_path / fmt), fmt).collect())) == expected


def test_line_numbers_over_many_splits(spark, tmp_path):
    paths = []
    for name in ("one", "two"):
        lines = [f"{name} {i} " + "x" * (i % 50) for i in range(3000)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
        paths.append(str(tmp_path / f"{name}.txt"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = D.read_dialog_lines(spark, paths)
        assert df.rdd.getNumPartitions() > 2
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 6000
    assert all(r["line_no"] == int(r["line"].split()[1]) + 1 for r in rows)
    assert {r["file"].rsplit("/", 1)[1][:3] for r in rows} == {"one", "two"}


def test_lines_round_trip_in_order(spark, tmp_path):
    original = "".join(f"{i} line\n" for i in range(500))
    (tmp_path / "in.txt").write_text(original)
    lines = D.read_dialog_lines(spark, str(tmp_path / "in.txt")).repartition(7)
    laid_out = lines.withColumns(
        {"dataset": F.lit("bst"), "split": F.lit("train"), "variant": F.lit("concepts")}
    )
    out = tmp_path / "out"
    D.write_dialog_lines(laid_out, str(out), 4, ("dataset", "split", "variant"))
    parts = sorted(glob.glob(f"{out}/dataset=bst/split=train/variant=concepts/part-*"))
    assert len(parts) > 1
    assert "".join(open(p).read() for p in parts) == original
    back = D.read_layout(spark, str(out), "bst", "train", D.variant_name("bst", True))
    again = back.orderBy("line_no").collect()
    assert [r["line"] for r in again] == original.splitlines()
    assert [r["line_no"] for r in again] == list(range(1, 501))
    assert D.read_layout(spark, str(out), "bst", "valid").count() == 0


def test_json_episodes(spark, tmp_path):
    episodes = [
        {"chosen_topic": "t", "dialog": [{"speaker": "0_W", "text": "a\nb", "concepts": ["c"]}]},
        {"dialog": []},
    ]
    (tmp_path / "e.json").write_text(json.dumps(episodes))
    df = D.read_dialog_json(spark, str(tmp_path / "e.json"))
    rows = df.orderBy("episode_id").collect()
    assert [(r["episode_id"], r["chosen_topic"], len(r["dialog"])) for r in rows] == [(1, "t", 1), (2, None, 0)]
    D.write_dialog_json(df.drop("file", "episode_id"), str(tmp_path / "out"))
    again = D.read_dialog_json(spark, str(tmp_path / "out"), array_file=False)
    assert sorted(len(r["dialog"]) for r in again.collect()) == [0, 1]


@pytest.mark.parametrize("split, indent", [(150, None), (700, 2), (1 << 20, None)])
def test_array_files_are_read_by_many_tasks(spark, tmp_path, split, indent):
    rng = random.Random(split)
    texts = ["plain", 'say "hi"', "back\\slash \\\\", "}{][", '\\"}', "é\u2028 日本", "two\nlines", "", "x" * 400, "a,b"]
    files = []
    for n in (30, 1, 0):
        episodes = [
            {"id": i, "dialog": [{"text": rng.choice(texts), "concepts": rng.choices(texts, k=rng.randrange(3))}
                                 for _ in range(rng.randrange(4))], "extra": {"deep": [[rng.choice(texts)]]}}
            for i in range(n)
        ]
        files.append(episodes)
        (tmp_path / f"e{n}.json").write_text(json.dumps(episodes, indent=indent, ensure_ascii=False))
    schema = (
        "id long, dialog array<struct<text: string, concepts: array<string>>>, extra struct<deep: array<array<string>>>"
    )
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        parts = spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions()
        rows = D.read_dialog_json(spark, str(tmp_path), schema).collect()
        free = D.read_dialog_json(spark, str(tmp_path)).filter("id = 29").first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert parts > 10 or split > 10_000
    for episodes in files:
        got = {r["episode_id"]: r.asDict(True) for r in rows if f"/e{len(episodes)}.json" in r["file"]}
        assert sorted(got) == list(range(1, len(episodes) + 1))
        for i, e in enumerate(episodes):
            assert {c: got[i + 1][c] for c in e} == e
    assert [e["text"] for e in free["dialog"]] == [e["text"] for e in files[0][29]["dialog"]]


def test_arrays_without_broadcast(spark, tmp_path):
    episodes = [{"id": i, "text": "}{" * (i % 40)} for i in range(40)]
    (tmp_path / "e.json").write_text(json.dumps(episodes))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = D.read_dialog_json(spark, str(tmp_path / "e.json"), "id long, text string").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["episode_id"], r["id"], r["text"]) for r in rows) == [
        (i + 1, i, e["text"]) for i, e in enumerate(episodes)
    ]


def test_sources_are_scanned_once(spark, tmp_path):
    """After the rows have been staged the source may change: nothing reads it again."""
    lines = "".join(f"line {i}\n" for i in range(400))
    path = tmp_path / "dump.txt.gz"
    path.write_bytes(gzip.compress(lines.encode()))
    df = D.read_dialog_lines(spark, str(path))
    path.write_bytes(gzip.compress(b"other\n"))
    rows = df.orderBy("line_no").collect()
    assert [r["line"] for r in rows] == lines.splitlines()
    assert [r["line_no"] for r in rows] == list(range(1, 401))


def test_variant_names():
    assert D.variant_name("convai", True) == "self_original_concepts"
    assert D.variant_name("convai", True, False) == "self_original_concepts_no_cands"
    assert D.variant_name("bst", False) == "plain"
