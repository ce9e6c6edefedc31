"""Redaction of streams: the column operators are stateless and run as they are; a shared budget keeps state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.policy import Policy
from ..functions.ship import ship
from ..operators.frames import redact_columns
from ..operators.groups import BATCH, prepared, spend
from ..operators.results import BIT, EXHAUSTED, partial_summaries


def redacted_stream(spark: SparkSession, path: str, schema, policy: Policy, source: str = "parquet") -> DataFrame:
    """A file stream whose sensitive columns are masked before anything else sees them."""
    return redact_columns(spark.readStream.format(source).schema(schema).load(path), policy)


def write_stream(stream: DataFrame, path: str, checkpoint: str, sink: str = "parquet"):
    """Append the stream to files, exactly once; stops when the input at hand is done."""
    return stream.writeStream.format(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


PREPARED = ("__op", "__value", "__content_type", "__shown", "__raw")


def _in_order(policy: Policy, frames: Iterator[pd.DataFrame], left: int) -> Iterator[tuple[list[tuple], int]]:
    """Outcomes (index, text, completion, reasons) of a key's items of one micro-batch in index order, and the budget left after them.

    Frames come in any order. Whatever lies behind the place where the budget
    ends stays exhausted, whatever else comes; so it is given at once, and no
    more is held than the budget has room for.
    """
    held: list[tuple] = []

    def taken() -> tuple[list[tuple], int, int]:
        out, rest = [], left
        for k, (i, *item) in enumerate(held):
            if rest <= 0:
                return out, 0, k
            text, completion, reasons, rest = spend(policy, tuple(item), rest)
            out.append((i, text, completion, reasons))
        return out, rest, len(held)

    gone = lambda items: [(i, "", EXHAUSTED, BIT["output_limit_reached"]) for i, *_ in items]
    for frame in frames:
        frame = frame.astype(object).where(frame.notna(), None)
        held += list(zip(frame["__index"], *(frame[c] for c in PREPARED), strict=True))
        held.sort(key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0))
        _, _, k = taken()
        if k < len(held):
            yield gone(held[k:]), left
            del held[k:]
    out, rest, _ = taken()
    yield out, rest


def _keyed(stream: DataFrame, batch: str, index: str, policy: Policy, op: str, name: str, value: str):
    ship(stream.sparkSession)
    return stream.select(F.col(batch).alias("__batch"), F.col(index).alias("__index"), *prepared(stream, policy, op, name, value)).groupBy("__batch")


def _timeout(idle: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout


def stream_batch_items(stream: DataFrame, batch: str, index: str, policy: Policy, op: str = "op", name: str = "name", value: str = "value", idle: int | None = None) -> DataFrame:
    """batch_items over a stream: the budget left is the state of a batch.

    Items of one micro-batch are taken in index order; a later micro-batch goes
    on where it stopped, so that a late item comes after those that were there
    before it, whatever its index. With `idle`, a batch without items for so many
    milliseconds is forgotten, and begins anew if it appears again; such a
    stream runs on for its timeouts, so that write_stream() would not end.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        left = state.get[0] if state.exists else policy.limits.max_output_bytes
        for out, left in _in_order(policy, frames, left):
            yield pd.DataFrame([(key[0], *x) for x in out], columns=[batch, index, "text", "completion", "reasons"])
        state.update((left,))
        if idle is not None:
            state.setTimeoutDuration(idle)

    kinds = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in (batch, index))
    return _keyed(stream, batch, index, policy, op, name, value).applyInPandasWithState(run, f"{kinds}, {BATCH}", "left long", "append", _timeout(idle))


def stream_compose(stream: DataFrame, batch: str, index: str, policy: Policy, op: str = "op", name: str = "name", value: str = "value", idle: int | None = None) -> DataFrame:
    """compose() of batch_items over a stream, in update mode: after each micro-batch the text so far of every batch that had items.

    The state of a batch is its text, no longer than the budget, what is left of
    it, the worst completion and all reasons; a micro-batch's items are appended
    in index order, late ones after those before them. With `idle`, a batch
    without items for so many milliseconds is forgotten, as in stream_batch_items.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        left, text, completion, reasons = state.get if state.exists else (policy.limits.max_output_bytes, "", 0, 0)
        for out, rest in _in_order(policy, frames, left):
            text += "".join(t for _, t, _, _ in out)
            completion = max([completion, *(c for *_, c, _ in out)])
            for *_, r in out:
                reasons |= r
        state.update((rest, text, completion, reasons))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame([(key[0], text, completion, reasons)], columns=[batch, "text", "completion", "reasons"])

    kind = f"`{batch}` {stream.schema[batch].dataType.simpleString()}, {BATCH}"
    return _keyed(stream, batch, index, policy, op, name, value).applyInPandasWithState(run, kind, "left long, text string, completion int, reasons int", "update", _timeout(idle))


def keep_partial_summaries(stream: DataFrame, keys: list[str], r: str, path: str, checkpoint: str):
    """Add the partial summaries of each micro-batch of a stream of results to a table at path; stops when the input at hand is done.

    A micro-batch that is repeated after a failure replaces its own rows, so that
    merge_partials() of the table is the summary of all results, each once.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        partial_summaries(rows, keys, r).write.mode("overwrite").parquet(f"{path}/micro_batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
