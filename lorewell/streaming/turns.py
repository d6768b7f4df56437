"""Knowledge for turns as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from lorewell.functions.text import STOP_WORDS
from lorewell.operators.augment import augment_turns
from lorewell.operators.knowledge import EdgeIndex
from lorewell.operators.terms import Lemma


def augment_turn_stream(
    stream: DataFrame,
    index: EdgeIndex,
    sink: str,
    checkpoint: str,
    keys: tuple[str, ...] = ("conv_id", "turn"),
    lemma: Lemma | None = None,
    trigger: dict | None = None,
    stop_words: Sequence[str] = STOP_WORDS,
) -> StreamingQuery:
    """Augment each micro-batch with the batch operator and write it to its own folder.

    Repeats are looked for inside one message only, so batches do not depend on
    each other. A batch that runs again overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read for the lookup and for the join back
        out = augment_turns(batch, index, keys, lemma=lemma, stop_words=stop_words)
        out.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode(
            "overwrite"
        ).parquet(f"{sink}/batch={batch_id}")
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_augmented(df: DataFrame, sink: str) -> DataFrame:
    """The sink as a table; `df` gives the schema of the turns."""
    schema = StructType([*df.schema.fields, StructField("batch_id", LongType())])
    return df.sparkSession.read.schema(schema).parquet(f"{sink}/batch=*")
