"""Streams: rate windows, late results, new entries, tag splitting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def drained(df: DataFrame, mode: str, path: str) -> DataFrame:
    """What a streaming DataFrame gives of its input as it is now, written below ``path`` and read back.

    Every trigger's rows go to a folder of its number, in place of what a lost try of the same trigger left there, so they count once; its
    checkpoint lies beside them. Nothing goes through the driver. In mode complete the last trigger's rows are the result.
    """
    schema, last = df.schema, []

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/trigger={number}")
        last.append(number)

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = df.sparkSession
    if not last:
        return spark.createDataFrame([], schema)
    if mode == "complete":
        return spark.read.schema(schema).parquet(f"{path}/rows/trigger={max(last)}")
    return spark.read.schema(schema).parquet(f"{path}/rows").select(*schema.names)


def hourly_requests(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Requests by user and hour of an event stream (ts timestamp, user_id); windows close ``late`` after the latest event."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "user_id", "n")


def sliding_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events by type in windows of six hours, one starting every three."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "6 hours", "3 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def new_entries(manifest: DataFrame, late: str = "30 days") -> DataFrame:
    """Entries of a manifest stream (seen_at, source, source_id) not seen before, with bounded state."""
    return manifest.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["source", "source_id"])


#: How long a document or a text stream without news keeps its state, in milliseconds.
FORGET = 3_600_000


def _timeout(forget: int | None) -> str:
    """With a timeout a query runs on without new data, to look for what has timed out; one that is to end by itself takes None."""
    return GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout


def current_status(results: DataFrame, forget: int | None = FORGET) -> DataFrame:
    """doc_id, revision, status, stale of a stream of index results: one of an older revision than a document's newest is
    stale and puts nothing in its place. Results of a trigger count in order of ``seq``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest = state.get[0] if state.exists else -1
        pdf = pd.concat(list(batches)).sort_values("seq", kind="stable")
        before = pdf["revision"].cummax().shift(fill_value=newest).clip(lower=newest)
        state.update((max(newest, int(pdf["revision"].max())),))
        if forget:
            state.setTimeoutDuration(forget)
        yield pd.DataFrame({"doc_id": key[0], "revision": pdf["revision"], "status": pdf["status"], "stale": pdf["revision"] < before})

    return results.groupBy("doc_id").applyInPandasWithState(
        step, "doc_id long, revision long, status string, stale boolean", "newest long", "append", _timeout(forget)
    )


def without_tag(deltas: DataFrame, tag: str = "think", forget: int | None = FORGET) -> DataFrame:
    """stream_id, seq, text of text deltas (stream_id, seq, payload, last) with what stands between the tags left out, wherever
    deltas cut them.

    State is whether a stream is inside the tag and the few characters that may begin one. They are given out with the delta
    marked ``last``, or by themselves (seq null) when a stream goes without news for an hour; inside a tag they are dropped.
    """
    marks = (f"<{tag}>", f"</{tag}>")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inside, held = state.get if state.exists else (False, "")
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"stream_id": [key[0]], "seq": pd.array([None], "Int64"), "text": ["" if inside else held]})
            return
        rows, ended = [], False
        pdf = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for seq, payload, last in zip(pdf["seq"], pdf["payload"], pdf["last"], strict=True):
            held += payload
            out = ""
            while (at := held.find(marks[inside])) >= 0:
                out += "" if inside else held[:at]
                held, inside = held[at + len(marks[inside]) :], not inside
            mark = marks[inside]
            keep = 0 if last else next((n for n in range(min(len(mark) - 1, len(held)), 0, -1) if mark.startswith(held[-n:])), 0)
            out += "" if inside else held[: len(held) - keep]
            held, ended = held[len(held) - keep :], ended or bool(last)
            rows.append((key[0], int(seq), out))
        if ended:
            state.remove()
        else:
            state.update((bool(inside), held))
            if forget:
                state.setTimeoutDuration(forget)
        yield pd.DataFrame(rows, columns=["stream_id", "seq", "text"])

    return deltas.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, seq long, text string", "inside boolean, held string", "append", _timeout(forget))
