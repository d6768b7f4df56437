"""Files in, files out: the three jobs one after the other."""

import glob
import json

import pytest

from lorewell.plans import jobs
from lorewell.sources import dialogs as D

DUMP = [
    ("IsA", "dog", "animal/n", 2.0),
    ("HasA", "dog", "tail", 1.0),
    ("HasA", "dog", "fur", 0.5),
    ("Synonym", "dog", "hound", 3.0),
    ("RelatedTo", "dog", "dogs", 3.0),
    ("UsedFor", "hot_dog", "eating", 1.0),
    ("IsA", "dog/n", "tail/n", 4.0),
]


def test_files_to_examples(spark, tmp_path):
    lines = [
        f'/a/{i}\t/r/{r}\t/c/en/{s}\t/c/en/{e}\t{{"weight": {w}}}'
        for i, (r, s, e, w) in enumerate(DUMP)
    ]
    lines.append("/a/9\t/r/IsA\t/c/en/a\t/c/en/b\t{}")
    (tmp_path / "dump.csv").write_text("\n".join(lines) + "\n")
    kb = f"{tmp_path}/kb"
    jobs.build_knowledge_base(spark, f"{tmp_path}/dump.csv", kb)
    assert spark.read.parquet(f"{kb}/filtered").count() == 5
    assert spark.read.parquet(f"{kb}/no_weight").count() == 1
    graph = {(r["start"], r["end"]): r["relation"] for r in spark.read.parquet(f"{kb}/graph").collect()}
    assert graph == {
        ("dog", "animal"): "/r/IsA",
        ("dog", "tail"): "/r/IsA",
        ("hot dog", "eating"): "/r/UsedFor",
    }
    index = jobs.load_index(spark, kb)
    assert jobs.load_index(spark, kb, all_relations=True).vectors.count() == 4

    out = f"{tmp_path}/with_concepts"
    bst = "text:x\tfree_message:my dog\tlabels:y\ntext:z\tlabels:y\tepisode_done:True\n"
    convai = "1 your persona: i like dogs.\n2 my dog\tyo\t\ta|b\n"
    ed = "conv_id,h\nhit:1,1,p,s,0,my dog,x,\nhit:1,2,p,s,0,a hot dog_comma_ yes,x,\n"
    said = [("0_A", "dog"), ("1_Wizard", "ok")]
    entries = [{"speaker": s, "text": t, "checked_sentence": {"k": t}, "candidates": [t]} for s, t in said]
    wow = [{"chosen_topic": "T", "persona": "p", "wizard_eval": 5, "dialog": entries}]
    for name, text in (("bst", bst), ("convai", convai), ("empathy", ed), ("wow", json.dumps(wow))):
        path = tmp_path / (f"{name}.json" if name == "wow" else f"{name}.txt")
        path.write_text(text)
        jobs.augment_dataset(spark, name, str(path), index, out)

    knowledge = "__knowledge__dog__IsA__animal__endknowledge____knowledge__dog__IsA__tail__endknowledge__"
    parts = sorted(glob.glob(f"{out}/lines/dataset=convai/split=train/variant=self_original_concepts/part-*"))
    written = "".join(open(p).read() for p in parts)
    assert written == f"1 your persona: i like dogs.\n2 my dog{knowledge}\tyo\t\ta|b\n"
    (files,) = glob.glob(f"{out}/files/dataset=convai/split=train/variant=self_original_concepts/run=*")
    back = D.read_line_files(spark, files).orderBy("line_no").collect()
    assert "".join(r["line"] + "\n" for r in back) == written
    assert {r["file"].rsplit("/", 1)[1] for r in back} == {"convai.txt"}
    checked = spark.read.parquet(f"{out}/checked/dataset=bst/split=train/variant=concepts")
    errors = checked.filter("error is not null").collect()
    assert [r["error"] for r in errors] == ["no free_message"]

    (part,) = glob.glob(f"{out}/episodes/dataset=wow/split=train/variant=concepts/part-*")
    (episode,) = [json.loads(x) for x in open(part)]
    assert episode.pop("file").endswith("wow.json") and episode.pop("episode_id") == 1
    assert [e.pop("concepts") for e in episode["dialog"]] == [knowledge, ""]
    assert episode == wow[0]  # no field is lost

    body = "\n__knowledge__dog__IsA__animal. dog__IsA__tail__endknowledge__"
    names = ("bst", "convai", "empathy")
    got = {n: jobs.read_examples(spark, n, out).orderBy("line_no").collect() for n in names}
    got["wow"] = jobs.read_examples(spark, "wow", out).collect()
    assert sorted(r["text"] for r in got["bst"]) == ["x" + body, "z\n__knowledge____endknowledge__"]
    assert [r["labels"] for r in got["convai"]] == [[], ["yo"]]
    assert [(r["text"], r["label"]) for r in got["empathy"]] == [("my dog" + body, "a hot dog, yes")]
    assert [(r["text"], r["labels"]) for r in got["wow"]] == [("dog" + body, ["ok"])]


def test_lines_are_checked_and_counted_in_one_pass(spark, tmp_path):
    good = "text:a\tlabels:b\tconcepts:c"
    rows = [good, good + "\teval_labels:x", "labels:b\tconcepts:c", "text:a\tconcepts:c", "text:a\tlabels:b", "text:a"]
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(rows)], "file string, line_no long, line string")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    watched = lines.mapInArrow(counted, lines.schema)
    counts = jobs.write_validated(watched, f"{tmp_path}/a")
    assert reads.value == len(rows)  # no line was read twice
    assert counts == {
        "lines": 6, "bad": 5, "eval_labels": 1, "missing_text": 1, "missing_labels": 2, "missing_concepts": 2,
    }
    assert [r["line_no"] for r in jobs.read_validated(spark, f"{tmp_path}/a").collect()] == [1]
    bad = jobs.read_validated(spark, f"{tmp_path}/a", "quarantine").orderBy("line_no").collect()
    assert [len(r["errors"]) for r in bad] == [1, 1, 1, 1, 2]
    with pytest.raises(ValueError, match="5 of 6"):
        jobs.write_validated(lines, f"{tmp_path}/b", strict=True)
    assert jobs.write_validated(lines.limit(1), f"{tmp_path}/c", strict=True)["bad"] == 0
