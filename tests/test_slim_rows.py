"""Runs and dumps shuffle slim rows."""

import glob

from pyspark.sql import functions as F

from lorewell.plans import fixtures as fx
from lorewell.sources import dialogs as D

from .test_plans import plan


def test_runs_are_shuffled_once_and_counted(spark):
    docs = spark.createDataFrame(
        [("en", "red fox runs. red fox runs the red fox"), (None, "red fox"), ("de", None)], "lang string, text string"
    )
    runs = fx.word_runs(docs)
    assert "ENSURE_REQUIREMENTS" not in plan(runs)
    got = {(r.lang, r.w, r.w2, r.w3): r.n for r in runs.collect()}
    assert got == {
        ("en", "red", "fox", None): 3, ("en", "red", "fox", "runs"): 2, ("en", "fox", "runs", None): 2,
        ("en", "fox", "runs", "red"): 1, ("en", "runs", "red", None): 1, ("en", "runs", "red", "fox"): 1,
        (None, "red", "fox", None): 1,
    }


def test_lines_may_be_made_where_they_are_written(spark, tmp_path):
    rows = spark.range(100).select(F.lit("f").alias("file"), ((F.col("id") * 37) % 100).alias("n"))
    text = F.concat(F.lit("line "), F.col("n").cast("string"))
    path = str(tmp_path / "dump")
    D.write_dialog_lines(rows, path, 4, line_no=F.col("n"), line=text, compression="gzip")
    assert glob.glob(f"{path}/part-*.gz")
    back = D.with_line_numbers(spark.read.text(path), folder_is_file=True).orderBy("line_no").collect()
    assert [r["value"] for r in back] == [f"line {i}" for i in range(100)]
