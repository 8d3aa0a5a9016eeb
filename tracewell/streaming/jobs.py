"""Structured Streaming jobs over the event log.

Every job reads files as they come, has its own checkpoint in the shared folder, and stops when
what is there has been read (``availableNow``), so that batch queries can use its result.  Facts
that are later than the watermark are dropped by a windowed stream; a batch run over the log
reconciles them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.plans.staging import staged_path

LEASE_SECONDS = 45


def event_stream(spark: SparkSession, path: str, watermark: str = "10 minutes") -> DataFrame:
    """The event log as a stream with event time."""
    static = spark.read.parquet(path)
    exact = path if path.endswith("*") else f"{path[:-1]}[{path[-1]}]"  # streams take folders or patterns; this one fits the path alone
    stream = spark.readStream.schema(static.schema).parquet(exact)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def drained(stream: DataFrame, name: str, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """What a stream has written once all input is read."""
    spark = stream.sparkSession
    out = staged_path(spark, name)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    else:
        last: list[int] = []

        def write(batch: DataFrame, number: int) -> None:  # a folder for each batch: one that is tried again replaces its own
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            last[:] = [number]

        query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    if not last:
        return spark.createDataFrame([], stream.schema)  # the source had no batch
    return spark.read.schema(stream.schema).parquet(f"{out}/batch={last[0]}" if mode == "complete" else f"{out}/batch=*")


def snapshots(events: DataFrame) -> DataFrame:
    """The newest state of every job."""
    newest = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(newest.alias("s"), F.count("*").alias("calls")).select("user_id", "s.event_id", "s.event_type", "s.value", "calls")


STAGES = {"signup": 1, "view": 2, "click": 3, "purchase": 4, "error": 0}


def staged(events: DataFrame) -> DataFrame:
    """Stage numbers and flags."""
    step = F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair))
    number = F.try_element_at(step, F.col("event_type"))
    return events.withColumns({"step": number, "is_active": number.between(1, 3), "is_complete": number == 4})


def distinct_dispatches(events: DataFrame) -> DataFrame:
    """One dispatch per logical request within the watermark."""
    return events.dropDuplicatesWithinWatermark(["user_id", "event_type", "props"])


def matched(reservations: DataFrame, settlements: DataFrame, within: str) -> DataFrame:
    """Reservations with their settlement, or without one once its time is over."""
    near = F.expr(f"user_id = s_user_id AND s_ts >= ts AND s_ts <= ts + INTERVAL {within}")
    return reservations.join(settlements, near, "leftOuter")


def day_spending(events: DataFrame) -> DataFrame:
    """Calls and spending per UTC day."""
    return events.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("calls"), F.sum("value").alias("amount")).select(F.to_date("w.start").alias("day"), "calls", F.round("amount", 2).alias("amount"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Working sessions between heartbeats."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("beats")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def fault_streaks(events: DataFrame) -> DataFrame:
    """(user_id, event_id, streak) after each event: errors in a row, state per user.

    Events are put in order within a micro-batch; one that comes in a later batch than its successors counts when it comes.  ``sequence.streaks``
    over the whole log gives the streaks in order of time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for kind in rows["event_type"]:
            streak = streak + 1 if kind == "error" else 0
            out.append(streak)
        state.update((streak,))
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "streak": out})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, streak int", "streak int", "append", GroupStateTimeout.NoTimeout)


def admission(events: DataFrame, budget: float) -> DataFrame:
    """Streaming admission, state = what a user has spent; rejected requests consume nothing.

    Requests are admitted in order within a micro-batch, and batches as they come; ``ledger.admitted`` over the whole log gives the order of time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for amount in rows["value"]:
            fits = used + amount <= budget + 1e-9
            used += amount if fits else 0.0
            out.append(fits)
        state.update((used,))
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "admitted": out})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, admitted boolean", "used double", "append", GroupStateTimeout.NoTimeout)


def expired_leases(events: DataFrame, seconds: int = LEASE_SECONDS) -> DataFrame:
    """(user_id, last_beat) for each silence longer than a lease, by event-time timeout."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "last_beat": [pd.Timestamp(last, unit="us")]})
            return
        beats = sorted(int(t.value // 1_000) for frame in batches for t in frame["ts"])
        if state.exists:
            beats = [state.get[0], *beats]
        gone = [a for a, b in zip(beats, beats[1:]) if b - a > seconds * 1_000_000]
        state.update((beats[-1],))
        state.setTimeoutTimestamp(max(beats[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]] * len(gone), "last_beat": [pd.Timestamp(t, unit="us") for t in gone]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, last_beat timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def incremental_audit(events: DataFrame, facts: list, verdict, name: str) -> DataFrame:
    """Per material, facts kept up to date by the stream; each micro-batch judges only the materials that it touches.

    ``facts`` are aggregates over a material's events, whose state the stream keeps, so the log is never read again.
    """
    spark = events.sparkSession
    out = staged_path(spark, name)

    def audit(batch: DataFrame, number: int) -> None:
        batch.withColumn("passed", verdict).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    touched = events.groupBy("user_id").agg(*facts)
    query = touched.writeStream.foreachBatch(audit).outputMode("update").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(out).drop("part")
    last = rows.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return rows.join(last.hint("merge"), ["user_id", "batch"], "left_semi").drop("batch")


def accepted_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Files as they come; a content that has been accepted before, under whatever name, is not accepted again."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)
    named = stream.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    return named.dropDuplicates(["sha256"])
