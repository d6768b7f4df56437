"""Live turns give what the batch gives."""

from lorewell.operators.augment import augment_turns
from lorewell.operators.knowledge import index_edges
from lorewell.streaming.turns import augment_turn_stream, read_augmented

SCHEMA = "conv_id long, turn long, text string"


def test_stream_equals_batch(spark, tmp_path):
    edges = spark.createDataFrame(
        [("dog", "pet", "/r/IsA", 1.0), ("cat", "tail", "/r/HasA", 1.0)],
        "start string, end string, relation string, weight double",
    )
    index = index_edges(edges, 3, None)
    turns = [(c, t, f"dog {t} and cat {c}") for c in range(4) for t in range(3)]
    for i in range(3):
        part = spark.createDataFrame(turns[i * 4 : i * 4 + 4], SCHEMA)
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = (
        spark.readStream.schema(SCHEMA)
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{tmp_path}/in/*")
    )
    sink, progress = f"{tmp_path}/out", f"{tmp_path}/progress"
    augment_turn_stream(source, index, sink, progress).awaitTermination()
    table = spark.createDataFrame(turns, SCHEMA)
    got = read_augmented(table, sink)
    assert got.select("batch_id").distinct().count() == 3
    expected = sorted(map(tuple, augment_turns(table, index).collect()))
    assert sorted(map(tuple, got.drop("batch_id").collect())) == expected
    # nothing new: a second run adds nothing
    augment_turn_stream(source, index, sink, progress).awaitTermination()
    assert read_augmented(table, sink).count() == len(turns)
