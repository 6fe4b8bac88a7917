"""The catalogue of a decoding's event log, as a table or as a stream.

Events are (kind, ts, payload): one of ten kinds, whose fields are in a VARIANT. A log is folded by the subject
that its events are about: what has happened to it, how much came out of it, and whether it has been quiet
for so long that it counts as closed. Over a table that is one aggregation; over a stream a state for each
subject, with a timer that closes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The kinds of events, the field that names the subject, and the field that counts what came out.
KINDS = {
    "LibraryImported": ("library_id", "artifact_count"), "ArtifactDiscovered": ("library_id", None), "ArtifactDecoded": ("artifact_id", "instruction_count"), "FlowBuilt": ("artifact_id", "block_count"),
    "TypesInferred": ("artifact_id", "type_count"), "PbIrBuilt": ("unit_id", "member_count"), "CoreIrNormalised": ("module_id", "item_count"), "UiIrBuilt": ("tree_id", "node_count"),
    "TargetGenerated": ("target_id", "file_count"), "RoundTripValidated": ("original_id", None),
}

PROGRESS = "subject string, events long, amount long, kinds array<string>, first_ts timestamp, last_ts timestamp, closed boolean"


def _field(which: int, kind: str, payload: str, of: str) -> Column:
    out = F.lit(None).cast(of)
    for name, fields in KINDS.items():
        if fields[which]:
            out = F.when(F.col(kind) == name, F.try_variant_get(F.col(payload), f"$.{fields[which]}", of)).otherwise(out)
    return out


def typed(events: DataFrame, kind: str = "kind", ts: str = "ts", payload: str = "payload") -> DataFrame:
    """kind, ts, subject, amount, fault: unknown kind, or no subject, or no amount where the kind has one; else null. A
    fault is a row, not an error."""
    subject, amount = _field(0, kind, payload, "string"), _field(1, kind, payload, "long")
    counted = F.col(kind).isin(*[k for k, fields in KINDS.items() if fields[1]])
    rows = events.select(F.col(kind).alias("kind"), F.col(ts).alias("ts"), subject.alias("subject"), amount.alias("amount"))
    known = F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    counted = F.col("kind").isin(*[k for k, fields in KINDS.items() if fields[1]])
    return rows.withColumn("fault", F.when(~known, "unknown kind").when(F.col("subject").isNull(), "no subject").when(counted & F.col("amount").isNull(), "no amount"))


def metrics(rows: DataFrame) -> DataFrame:
    """One row of `typed` events: total_libraries, total_artifacts, total_functions (which no event counts), faults; of a
    stream, so far (complete mode)."""
    return rows.agg(
        F.count_if((F.col("kind") == "LibraryImported") & F.col("fault").isNull()).alias("total_libraries"), F.count_if((F.col("kind") == "ArtifactDiscovered") & F.col("fault").isNull()).alias("total_artifacts"),
        F.lit(0).cast("long").alias("total_functions"), F.count_if(F.col("fault").isNotNull()).alias("faults"),
    )


def progress(rows: DataFrame, idle: str = "1 day", late: str = "0 seconds") -> DataFrame:
    """PROGRESS of each subject of `typed` events (faults are left out): its events, the sum of their amounts, their
    kinds, first and last time, and whether the log went on for `idle` and `late` after the last. The log's end
    is one aggregate row, which every subject is compared with."""
    sound = rows.where("fault IS NULL AND ts IS NOT NULL")
    per = sound.groupBy("subject").agg(F.count("*").alias("events"), F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    end = F.broadcast(per.agg(F.max("last_ts").alias("_end")))
    closed = F.col("last_ts") + F.expr(f"INTERVAL {idle}") <= F.col("_end") - F.expr(f"INTERVAL {late}")
    return per.join(end).select("subject", "events", "amount", "kinds", "first_ts", "last_ts", closed.alias("closed"))


class _Progress(StatefulProcessor):
    """A subject's sums, and a timer `idle` milliseconds after its last event."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", "events long, amount long, kinds string, first_ts timestamp, last_ts timestamp")

    @staticmethod
    def _row(key: tuple, state: tuple, closed: bool) -> pd.DataFrame:
        events, amount, kinds, first, last = state
        return pd.DataFrame({"subject": [key[0]], "events": [events], "amount": [amount], "kinds": [kinds.split(",")], "first_ts": [pd.Timestamp(first)], "last_ts": [pd.Timestamp(last)], "closed": [closed]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events, amount, kinds, first, last = tuple(self.state.get()) if self.state.exists() else (0, 0, "", None, None)
        every = set(filter(None, kinds.split(",")))
        for batch in rows:
            events, amount = events + len(batch), amount + int(batch["amount"].fillna(0).sum())
            every |= set(batch["kind"])
            low, high = batch["ts"].min().to_pydatetime(), batch["ts"].max().to_pydatetime()
            first, last = low if first is None else min(first, low), high if last is None else max(last, high)
        state = events, amount, ",".join(sorted(every)), first, last
        self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.Timestamp(last).value // 1_000_000) + self.idle)
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, tuple(self.state.get()), True)

    def close(self) -> None:
        pass


def progress_stream(rows: DataFrame, idle_seconds: int = 86_400, late: str = "0 seconds") -> DataFrame:
    """PROGRESS of a stream of `typed` events (update mode): a row for each subject that a batch has events of, and one
    with closed when the watermark has passed its last event by so many seconds. Needs the RocksDB state
    store (spark.sql.streaming.stateStore.providerClass) and a session in UTC."""
    sound = rows.where("fault IS NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return sound.groupBy("subject").transformWithStateInPandas(_Progress(idle_seconds * 1000), PROGRESS, "Update", "EventTime")
