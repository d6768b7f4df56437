"""Knowledge of live conversations equals that of the batch, over batches and restarts."""

import random
import time

import pytest

from lorewell.operators import knowledge as K
from lorewell.streaming.context import context_stream, read_context
from tests.test_properties import random_edges, random_messages

SCHEMA = "conv_id long, turn long, text string"


@pytest.fixture(scope="module")
def index(spark):
    _, edges = random_edges(spark, 41)
    return K.index_edges(edges, 3, 5)


def put(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)


def source(spark, folder, files=1):
    return (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(f"{folder}/*")
    )


def turns_of(spark, seed, conversations=4, n=6):
    texts, _ = random_messages(spark, seed, conversations * n)
    return [(i % conversations, i // conversations, t) for i, t in enumerate(texts)]


def known(df):
    return sorted(map(tuple, df.collect()))


def test_stream_equals_batch_over_batches_and_a_restart(spark, index, tmp_path):
    turns = turns_of(spark, 42)
    parts = [turns[i : i + 5] for i in range(0, len(turns), 5)]
    sink, progress = f"{tmp_path}/out", f"{tmp_path}/progress"
    for i, part in enumerate(parts[:2]):
        put(spark, part, f"{tmp_path}/in/{i}")
    context_stream(source(spark, f"{tmp_path}/in"), index, sink, progress).awaitTermination()
    first = spark.createDataFrame(sum(parts[:2], []), SCHEMA)
    assert known(read_context(spark, sink)) == known(K.context_knowledge(first, index))
    # more turns come while nothing runs; the restarted query knows the words it has had
    for i, part in enumerate(parts[2:], 2):
        put(spark, part, f"{tmp_path}/in/{i}")
    context_stream(source(spark, f"{tmp_path}/in"), index, sink, progress).awaitTermination()
    whole = spark.createDataFrame(turns, SCHEMA)
    assert known(read_context(spark, sink)) == known(K.context_knowledge(whole, index))
    batches = spark.read.parquet(f"{sink}/batch=*").count()
    assert batches > 0


def test_one_batch_in_any_order(spark, index, tmp_path):
    turns = turns_of(spark, 43)
    random.Random(1).shuffle(turns)
    put(spark, turns, f"{tmp_path}/in/0")
    context_stream(
        source(spark, f"{tmp_path}/in"), index, f"{tmp_path}/out", f"{tmp_path}/progress"
    ).awaitTermination()
    whole = spark.createDataFrame(turns, SCHEMA)
    assert known(read_context(spark, f"{tmp_path}/out")) == known(K.context_knowledge(whole, index))


@pytest.mark.parametrize("forget_after_ms, times", [(1, 2), (3_600_000, 1)])
def test_words_are_forgotten(spark, tmp_path, forget_after_ms, times):
    edges = spark.createDataFrame(
        [("dog", "pet", "/r/IsA", 1.0)], "start string, end string, relation string, weight double"
    )
    index = K.index_edges(edges, 3, None)
    sink, progress = f"{tmp_path}/out", f"{tmp_path}/progress"
    for turn in range(2):
        put(spark, [(7, turn, "a dog")], f"{tmp_path}/in/{turn}")
        context_stream(
            source(spark, f"{tmp_path}/in"), index, sink, progress, forget_after_ms=forget_after_ms
        ).awaitTermination()
        time.sleep(0.1)
    assert spark.read.parquet(f"{sink}/batch=*").count() == times
    assert [tuple(r)[:2] for r in read_context(spark, sink).collect()] == [(7, 0)]
