"""Windowed counts that run on streams and tables alike, keyed merges of micro-batches, and conversations' state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators import graph
from ledgerloom.shared import Table

TURNS = 8


def sliding(events: DataFrame, ts: str, key: str, length: str, step: str, late: str | None = None) -> DataFrame:
    """window, key and events; on a stream, late bounds how long rows are waited for."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, length, step), key).agg(F.count("*").alias("events"))


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("events"))


def new_rows(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Rows whose keys weren't seen within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def write_batches(stream: DataFrame, path: str, checkpoint: str):
    """Each micro-batch replaces its own folder, so a batch that runs again leaves no second copy."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_batches(stream: DataFrame, path: str, keys: list[str], *order: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """Merge micro-batches into a table by key, the last row in order counting; merging a batch again, or late, changes nothing.

    A batch reads and writes the buckets of its keys only.

    One batch is merged at a time, in order, so there is one writer whatever the number of sources;
    a source's maxFilesPerTrigger bounds what a batch holds.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        rows = transform(batch) if transform else batch
        Table(batch.sparkSession, path).merge(rows, keys, lambda both: graph.replace_rows(both, keys, *order))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_nodes(stream: DataFrame, path: str, sequence: str, checkpoint: str):
    """Merge micro-batches of node writes; a null never overwrites, and each property keeps the sequence that says what is later."""

    def put(batch: DataFrame, epoch: int) -> None:
        rows = graph.stamped(batch, graph.NODE, sequence)
        Table(batch.sparkSession, path).merge(rows, graph.NODE, lambda both: graph.merge_stamped(both, graph.NODE))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def conversation_state(turns: DataFrame, idle: int = 3_600_000) -> DataFrame:
    """conversation, turn, held and company of a stream of turns(conversation, turn, question, company).

    The state of a conversation is its last eight questions and the company named last; it is
    forgotten after idle milliseconds without a turn. Turns of one batch are taken in their order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, company = state.get if state.exists else ([], None)
        held, out = list(held), []
        for r in pd.concat(list(batches)).sort_values("turn").itertuples():
            held = [*held, r.question][-TURNS:]
            company = r.company if isinstance(r.company, str) and r.company else company
            out.append((key[0], r.turn, len(held), company))
        state.update((held, company))
        state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["conversation", "turn", "held", "company"])

    kind = turns.schema["conversation"].dataType.simpleString()
    return turns.groupBy("conversation").applyInPandasWithState(
        step, f"conversation {kind}, turn long, held int, company string", "held array<string>, company string", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
