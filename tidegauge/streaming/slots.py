"""Structured Streaming: slot micro-batches with idempotent effect, vessel state, stall alarms, positions store.

Batch backfill and the stream share :func:`transform_slot`, so history and live data can't drift apart.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.operators import events as ev
from tidegauge.sources import files


def transform_slot(df: DataFrame) -> DataFrame:
    """Retained columns of the region's rows with the matching legs, slot and day of publication."""
    d = ev.filter_region(ev.coerce_numeric(df), "gulf_match")
    keep = [c for c in files.RETAINED if c in d.columns]
    d = ev.slots(d).withColumn("dt", F.to_date("slot"))
    return d.select(*keep, "gulf_match", "slot", "dt")


def slot_scores(df: DataFrame) -> DataFrame:
    """(slot, events, articles, reports, goldstein, tone, score) of conflict rows."""
    return ev.tension(df.filter("slot is not null"), "slot")


def run_slots(source: DataFrame, store: str, scores: str, checkpoint: str, key: str = "GlobalEventID") -> StreamingQuery:
    """Process all there is of a stream of event rows; return the finished query.

    Each micro-batch is appended to the day partitions it touches, without the rows they hold already (by ``key`` and publication
    stamp): of the store only these two columns of these days are read, and nothing stored is written again. A batch that runs
    twice, or a slot that is delivered twice, therefore leaves the store as it was. The scores of the touched days, at most 96
    rows each, are computed anew and replaced.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        new = transform_slot(df).filter("dt is not null").dropDuplicates([key, "DATEADDED"])
        new = new.persist()
        try:
            days = [r[0] for r in new.select("dt").distinct().collect()]  # the days of one micro-batch
            if not days:
                return
            fresh = new
            if files.exists(spark, store):
                held = _days(spark, store, new.schema, days).select(key, "DATEADDED")
                fresh = new.join(held, [key, "DATEADDED"], "left_anti")
            fresh.repartition("dt").write.mode("append").partitionBy("dt").parquet(store)
            whole = _days(spark, store, new.schema, days)
            files.write_slots(slot_scores(whole).withColumn("dt", F.to_date("slot")), scores)
        finally:
            new.unpersist()

    q = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _days(spark: SparkSession, store: str, schema, days: list) -> DataFrame:
    return spark.read.schema(schema).parquet(store).filter(F.col("dt").isin(days))


def windowed_counts(source: DataFrame, late: str = "1 hour", once_by: list[str] | None = None) -> DataFrame:
    """(slot, n): rows per publication slot with a watermark; rows later than ``late`` are left out, and with ``once_by`` the
    redeliveries of a row within it."""
    d = _timed(source, late)
    d = d.dropDuplicatesWithinWatermark(once_by) if once_by else d
    w = d.groupBy(F.window("at", ev.SLOT)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("slot"), "n")


def deduplicated(source: DataFrame, late: str = "1 day", key: str = "GlobalEventID") -> DataFrame:
    """Rows without redeliveries within the watermark."""
    return _timed(source, late).dropDuplicatesWithinWatermark([key, "DATEADDED"]).drop("at")


def _timed(source: DataFrame, late: str) -> DataFrame:
    d = source.withColumn("at", ev.published().cast("timestamp")).filter("at is not null")
    return d.withWatermark("at", late)


STATE = "first_seen timestamp, last_seen timestamp, n long, lat double, lon double, sog double, name string, destination string, draught double"
VESSEL = "mmsi string, " + STATE + ", stalled boolean"
_FIELDS = ["lat", "lon", "sog", "name", "destination", "draught"]


def _merge(old: tuple | None, pdf: pd.DataFrame) -> tuple:
    """The record of a vessel: latest known value of every field, first and last time seen, rows so far."""
    pdf = pdf.dropna(subset=["ts_utc"]).sort_values("ts_utc", kind="stable")
    if not len(pdf):
        return old or (None, None, 0, *[None] * len(_FIELDS))
    first, last, n, *vals = old or (None, None, 0, *[None] * len(_FIELDS))
    lo, hi = pdf["ts_utc"].iloc[0].to_pydatetime(), pdf["ts_utc"].iloc[-1].to_pydatetime()
    late = last is not None and hi < last
    for i, f in enumerate(_FIELDS):
        known = pdf[f].dropna()
        if len(known) and (vals[i] is None or not late):
            x = known.iloc[-1]
            vals[i] = x if isinstance(x, str) else float(x)
    return (lo if first is None else min(first, lo), hi if last is None else max(last, hi), int(n) + len(pdf), *vals)


def vessel_state(source: DataFrame, stall_s: int = 120, late: str = "10 minutes") -> DataFrame:
    """A stream of vessel records (``VESSEL``), one whenever a vessel is heard; and one with ``stalled`` once the others have gone
    on for ``stall_s`` and ``late`` beyond its last ping. Time is event time, so a replay gives the same alarms."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = VESSEL.replace("string", "").split(", ")
        cols = [c.split()[0] for c in names]
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield pd.DataFrame([(key[0], *held, True)], columns=cols)
            return
        rec = state.get if state.exists else None
        for b in batches:
            rec = _merge(rec, b)
        state.update(rec)
        seen = int(pd.Timestamp(rec[1]).timestamp() * 1000) if rec[1] is not None else 0
        state.setTimeoutTimestamp(max(seen + stall_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *rec, False)], columns=cols)

    d = source.filter("mmsi is not null").withColumn("ts_utc", F.col("ts_utc").cast("timestamp"))
    d = d.withWatermark("ts_utc", late)
    return d.groupBy("mmsi").applyInPandasWithState(update, VESSEL, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def vessel_snapshot(positions: DataFrame) -> DataFrame:
    """The same records from a table at once."""
    p = positions.filter("mmsi is not null and ts_utc is not null")
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("ts_utc"))).alias(c)
    return p.groupBy("mmsi").agg(F.min("ts_utc").alias("first_seen"), F.max("ts_utc").alias("last_seen"), F.count(F.lit(1)).alias("n"), *(last(c) for c in _FIELDS))


def store_positions(source: DataFrame, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Positions into ``dt=/hour=`` partitions, exactly once; ``every`` such as ``300 seconds``, or all there is."""
    at: Column = F.col("ts_utc").cast("timestamp")
    d = source.filter(at.isNotNull()).withColumns({"dt": F.to_date(at), "hour": F.date_format(at, "HH")})
    w = d.writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint).partitionBy("dt", "hour")
    q = (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
    if not every:
        q.awaitTermination()
    return q


def file_stream(spark: SparkSession, folder: str, schema, per_batch: int = 1) -> DataFrame:
    """A parquet folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


#: Seconds after a slot's end at which its file can be expected.
PUBLISH_LAG_S = 240


def due_slots(last: Column, now: Column, lag_s: int = PUBLISH_LAG_S) -> Column:
    """The slots after ``last`` whose files are published by ``now``: aligned to the quarter hour, each once its end and the lag are over."""
    first = F.timestamp_seconds(F.floor(F.unix_timestamp(last.cast("timestamp")) / 900) * 900 + 900)
    final = F.timestamp_seconds(F.floor((F.unix_timestamp(now.cast("timestamp")) - lag_s) / 900) * 900 - 900)
    return F.when(first <= final, F.sequence(first, final, F.expr("interval 15 minutes"))).otherwise(F.array().cast("array<timestamp>"))


class Heartbeat(StreamingQueryListener):
    """A line of JSON in ``path`` for every progress of the session's streams: name, batch, rows, rows a second, event-time watermark and time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__()
        self.spark, self.path, self.beats = spark, path, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond, "at": p.timestamp, "watermark": dict(p.eventTime).get("watermark")}
        self.beats += 1
        fs, target = files._fs(self.spark, f"{self.path}/beat-{p.runId}-{p.batchId:09d}.json")
        out = fs.create(target, True)
        out.write(bytearray((json.dumps(row, default=str) + "\n").encode()))
        out.close()

    def onQueryTerminated(self, event) -> None:
        pass


def flushed(source: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """``source`` handed on batch by batch: at ``seconds``, or all there is; the rows a batch may hold are the source's own limit (``file_stream``'s
    ``per_batch`` files, a queue's ``maxOffsetsPerTrigger``), so a flush comes by count or by time, whichever is first."""
    w = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()


def write_snapshot(positions: DataFrame, path: str) -> None:
    """The records of all vessels into a new folder under ``path``, published by a pointer that readers follow: never half a snapshot."""
    spark = positions.sparkSession
    target = f"{path}/{uuid.uuid4().hex}"
    vessel_snapshot(positions).write.parquet(target)
    files.publish(spark, f"{path}/_CURRENT", {"path": target})


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(files.published(spark, f"{path}/_CURRENT")["path"])


def throughput(q: StreamingQuery) -> dict[str, float]:
    """Rows, seconds and rows a second of a finished query."""
    p = q.recentProgress
    rows = sum(x["numInputRows"] for x in p)
    s = sum(x["durationMs"].get("triggerExecution", 0) for x in p) / 1000
    return {"rows": float(rows), "seconds": s, "rows_per_s": rows / s if s else 0.0}
