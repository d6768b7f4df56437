"""Knowledge from the whole dialogue so far, for turns as they arrive.

A word is looked up once per conversation, so all that must be remembered of a conversation
is which words it has had. They are kept in the state store; what a batch brings anew goes through
the batch operators. A restarted query goes on from its checkpoint.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lorewell.functions.text import STOP_WORDS
from lorewell.operators.dense import DenseIndex
from lorewell.operators.knowledge import TRIPLE, EdgeIndex, first_known, rank_sentences
from lorewell.operators.terms import Lemma, message_sentences

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FreshWords(StatefulProcessor):
    """Leaves in the runs of a conversation's sentences only words it has not had before.

    Rows of one batch are taken in the order of turn and sentence. Emptied runs stay, so
    groups keep their numbers. Words carry the time they came up; those that are too old
    are dropped when the conversation goes on.
    """

    def __init__(self, turn: str, forget_after_ms: int | None):
        self.turn, self.forget_after_ms = turn, forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "surface string, at bigint")

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        now = int(1000 * time.time())
        held = list(self.seen.get())
        oldest = now - self.forget_after_ms if self.forget_after_ms is not None else 0
        live = [(word, at) for word, at in held if at >= oldest]
        seen = {word for word, _ in live}
        batch = pd.concat(list(rows)).sort_values([self.turn, "sent_no"], kind="stable")
        new: list[tuple[str, int]] = []

        def fresh(run: Sequence[str]) -> list[str]:
            kept = []
            for word in run:
                if word not in seen:
                    seen.add(word)
                    new.append((word, now))
                    kept.append(word)
            return kept

        batch["runs"] = [[fresh(run) for run in runs] for runs in batch["runs"]]
        if len(live) < len(held):
            self.seen.clear()
            new = live + new
        if new:
            self.seen.appendList(new)
        yield batch

    def close(self) -> None:
        pass


def fresh_sentences(
    stream: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
    stop_words: Sequence[str] = STOP_WORDS,
    forget_after_ms: int | None = None,
) -> DataFrame:
    """Cut sentences (conv, turn, sent_no, sentence, words, runs) whose runs hold new words only.

    A turn that comes after later ones of its conversation is taken as it comes: it has what
    they left. With `forget_after_ms` a word counts as new again that long after it came up.
    """
    sents = message_sentences(stream, [conv, turn], text, stop_words, dedupe=False)
    sents = sents.filter(F.size("runs") > 0)
    return sents.groupBy(conv).transformWithStateInPandas(
        statefulProcessor=FreshWords(turn, forget_after_ms),
        outputStructType=sents.schema,
        outputMode="Append",
        timeMode="None",
    )


def context_stream(
    stream: DataFrame,
    index: EdgeIndex | DenseIndex,
    sink: str,
    checkpoint: str,
    conv: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
    lemma: Lemma | None = None,
    stop_words: Sequence[str] = STOP_WORDS,
    forget_after_ms: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write what each batch of turns adds to the knowledge of its conversations.

    The state store must be able to hold lists: the session is set to the one that can, unless
    it names its own. A batch that runs again overwrites its own folder.
    """
    conf = stream.sparkSession.conf
    if "HDFSBackedStateStoreProvider" in conf.get("spark.sql.streaming.stateStore.providerClass"):
        conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    keys = [conv, turn]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read for the terms and for the counts
        ranked = rank_sentences(batch, index, keys, lemma)
        rows = ranked.select(*keys, "sent_no", "group_no", "rank", *TRIPLE, "score")
        rows.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        batch.unpersist()

    return (
        fresh_sentences(stream, conv, turn, text, stop_words, forget_after_ms)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_context(spark: SparkSession, sink: str, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """All that is known, once per conversation, with the place where it came up first."""
    places = f"{conv} bigint, {turn} bigint, sent_no bigint, group_no bigint, rank bigint"
    schema = f"{places}, start string, relation string, end string, score double"
    return first_known(spark.read.schema(schema).parquet(f"{sink}/batch=*"), conv, turn)
