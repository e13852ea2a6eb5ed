"""Streams: alerts on rising edges, sessions, daily costs, quotas, once-only notices. Event time with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tail(spark, folder: str) -> DataFrame:
    """New lines of text files that appear in a folder."""
    return spark.readStream.text(folder)


def rising_edges(events: DataFrame, resend_seconds: int = 6 * 3600) -> DataFrame:
    """(kind, ts) to send, of a stream (kind, ts, active): when a kind becomes active, and again once the span has passed since the last
    one while it stays so; cleared when inactive. State is two numbers a kind."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, sent = state.get if state.exists else (False, 0)
        out = []
        for row in pd.concat(list(frames)).sort_values("ts").itertuples():
            at = int(row.ts.value // 1000)
            if not row.active:
                active = False
            elif not active or at - sent >= resend_seconds * 1_000_000:
                out.append((key[0], row.ts))
                active, sent = True, at
        state.update((bool(active), int(sent)))
        yield pd.DataFrame(out, columns=["kind", "ts"])

    return events.groupBy("kind").applyInPandasWithState(step, "kind string, ts timestamp", "active boolean, sent long", "append", GroupStateTimeout.NoTimeout)


def idle_sessions(events: DataFrame, key: str = "user_id", gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(key, session, events): sessions that end after the gap; a microsecond more, because exactly the gap stays in a session."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", f"{gap} 1 microsecond").alias("session"), key).agg(F.count("*").alias("events"))


def daily_costs(log: DataFrame, hours: int = 8, late: str = "2 days") -> DataFrame:
    """(day, model, questions, cost) as days in a zone of fixed offset close; rows later than the watermark are dropped by it."""
    day = F.window("at", "1 day", startTime=f"{(24 - hours) % 24} hours")
    once = log.withWatermark("at", late).dropDuplicatesWithinWatermark(["log_id"])
    return once.groupBy(day.alias("day"), "model").agg(F.count("*").alias("questions"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost"))


def sliding_counts(events: DataFrame, kind: str = "event_type", size: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("span"), kind).agg(F.count("*").alias("n"))


def once_each(notices: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first notice of each key."""
    return notices.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def quota(calls: DataFrame, n: int) -> DataFrame:
    """(conversation, ts, allowed): the first n calls of each conversation pass; every call comes out, for the audit."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (used,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames)).sort_values("ts")
        allowed = [used + i < n for i in range(len(rows))]
        state.update((used + len(rows),))
        yield pd.DataFrame({"conversation": key[0], "ts": rows["ts"].to_numpy(), "allowed": allowed})

    return calls.groupBy("conversation").applyInPandasWithState(step, "conversation string, ts timestamp, allowed boolean", "used int", "append", GroupStateTimeout.NoTimeout)


def to_memory(stream: DataFrame, name: str, mode: str = "append"):
    """Runs a stream over what there is into a memory table: for tests and small snapshots."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def snapshots(lines: DataFrame, kind: str) -> DataFrame:
    """Status snapshots from a stream of JSON lines (value): the fields of `kind` and `readable`; what isn't an object is a row of nulls that
    isn't readable, so that it can alert."""
    read = F.from_json("value", kind, {"mode": "PERMISSIVE"})
    return lines.select(read.alias("s"), F.col("value").rlike(r"^\s*\{.*\}\s*$").alias("readable")).select("s.*", "readable")


def daily_summaries(status: DataFrame, hour: int, offset_hours: int = 8) -> DataFrame:
    """(key, day, ts): of a stream (key, ts, ...) the first time each local day that it isn't before `hour`. State is a day a key."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else ("",)
        out = []
        for row in pd.concat(list(frames)).sort_values("ts").itertuples():
            local = row.ts + pd.Timedelta(hours=offset_hours)
            day = f"{local:%Y-%m-%d}"
            if local.hour >= hour and day > last:
                out.append((key[0], day, row.ts))
                last = day
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "day", "ts"])

    return status.groupBy("key").applyInPandasWithState(step, "key string, day string, ts timestamp", "last string", "append", GroupStateTimeout.NoTimeout)
