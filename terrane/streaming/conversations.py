"""Conversations as streams: a sliding window of turns as state, contexts for every new turn, and scheduled rebuilds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.index import TURNS
from ..project import Project


def _slide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kept = list(zip(*state.get, strict=True)) if state.exists else []
    for frame in frames:
        rows = []
        for turn, text in sorted(zip(frame["turn"], frame["text"], strict=True)):
            kept = sorted([*kept, (int(turn), text)])[-TURNS:]
            rows.append((*key, int(turn), [t for _, t in kept]))
        yield pd.DataFrame(rows, columns=["query_id", "turn", "texts"])
    if kept:
        state.update(([n for n, _ in kept], [t for _, t in kept]))


def recent_turns(turns: DataFrame) -> DataFrame:
    """(query_id, turn, texts): with every new turn, the last six of its conversation, oldest first.

    turns: a stream of (query_id string, turn, text). Null and empty turns are dropped. State is six turns a
    conversation. A conversation's turns must arrive in order from one micro-batch to the next; within a batch they may not be.
    """
    given = turns.where("text <> '' and turn is not null").select(F.col("query_id").cast("string").alias("query_id"), F.col("turn").cast("long").alias("turn"), "text")
    return given.groupBy("query_id").applyInPandasWithState(
        _slide, "query_id string, turn long, texts array<string>", "turns array<long>, texts array<string>", "append", GroupStateTimeout.NoTimeout
    )


def windows_as_turns(windows: DataFrame) -> DataFrame:
    """The input of `Project.resolve` from a batch of recent_turns: one query for each turn, called query_id:turn."""
    return windows.select(F.concat_ws(":", "query_id", "turn").alias("query_id"), F.posexplode("texts").alias("turn", "text"))


def resolve_stream(project: Project, turns: DataFrame, write: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Resolve every new turn; write gets the activations, the passages and the number of each micro-batch.

    A batch can be replayed after a failure: writers that must not repeat rows key on the batch number.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            write(*project.resolve(windows_as_turns(batch)), number)
        finally:
            batch.unpersist()

    return recent_turns(turns).writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def keep_fresh(project: Project, checkpoint: str, seconds: int = 20) -> StreamingQuery:
    """Compare the folder with the last build every so many seconds, and rebuild after additions, changes or removals."""
    ticks = project.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, __: project.ensure_fresh(0)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
