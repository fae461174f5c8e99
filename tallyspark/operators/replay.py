"""Bounded, selective replay of dead letters as one batch job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..functions.time import clock
from ..schema import DEAD_LETTER
from ..sources.events import decoded, offset_ranges
from ..sources.log import Log, Ranges, appended, in_range
from .ingest import MICROS, message_key

__all__ = ["appended"]


def selection(ids: list[str | None]) -> list[str]:
    """Trimmed, without blanks and repetitions, in order; an error if nothing is left."""
    out = list(dict.fromkeys(s for x in ids if x and (s := x.strip("".join(map(chr, range(0x21)))))))
    if not out:
        raise ValueError("at least one event id is required")
    return out


def snapshot(letters: DataFrame) -> Ranges:
    """(partition, start, end) now; records that come later are beyond it. As many rows as partitions; none is an error.

    Of a ``Log`` its own ``ranges`` tell the same without reading rows.
    """
    ranges = [tuple(r) for r in offset_ranges(letters).collect()]
    if not ranges:
        raise ValueError("the log has no partitions")
    if any(start is None or end is None or start < 0 or end < start for _, start, end in ranges):
        raise ValueError("a partition's range is not whole")
    return ranges


def in_ranges(ranges: Ranges) -> Column:
    """Whether a record lies in the snapshot; the bounds reach the scan."""
    out = F.lit(False)
    for bounds in ranges:
        out = out | in_range(*bounds)
    return out


def selected(letters: DataFrame, ids: DataFrame, ranges: Ranges) -> DataFrame:
    """Letters (with ``event``) in range whose event id, as it stands, is among ``ids`` (eventId)."""
    return letters.where(in_ranges(ranges)).join(ids.select(F.col("eventId").alias("_id")).distinct(), F.col("event.eventId") == F.col("_id"), "left_semi")


def headers(now: Column | None = None, source: str = "dlq", prefix: str = "telemetry", run_id: str | None = None) -> Column:
    pair = lambda k, v: F.struct(F.lit(f"{prefix}.{k}").alias("key"), v.cast("string").cast("binary").alias("value"))
    return F.array(pair("replay", F.lit("true")), pair("replayed-at", clock(now)), pair("replay-source", trimmed(F.lit(source))), *([pair("replay-run", F.lit(run_id))] if run_id else []))


def republished(chosen: DataFrame, now: Column | None = None, source: str = "dlq", prefix: str = "telemetry", run_id: str | None = None, more: tuple[str | Column, ...] = ()) -> DataFrame:
    """(key, value, headers, ``more``): the unchanged events, marked as replayed."""
    return chosen.select(message_key(F.col("event.eventId"), F.col("event.tenantId")).alias("key"), F.to_json("event", MICROS).alias("value"), headers(now, source, prefix, run_id).alias("headers"), *more)


def audit(chosen: DataFrame, run_id: str, source: str, now: Column | None = None) -> DataFrame:
    """One row for a run: its id, source and time, how many records of how many events, and the offsets that they come from."""
    events = F.count_distinct("event.eventId").alias("events")
    sums = chosen.agg(F.count("*").alias("records"), events, F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))
    return sums.select(F.lit(run_id).alias("run_id"), trimmed(F.lit(source)).alias("source"), clock(now).alias("replayed_at"), "*")


def replay(spark: SparkSession, letters: Log, ids: list[str], raw: Log, now: Column | None, run_id: str, source: str = "dlq") -> int:
    """Appends the selected dead letters to the raw log, after what it holds, and returns how many the run wrote.

    The bounds are those of the dead-letter log when the run begins; a log without partitions is an error, an
    empty one replays nothing.  Records and audit row are one commit: a run that fails leaves neither, and a run id
    that has been committed is not replayed again, nor when another writer was faster (``Conflict``).
    A dead letter without an event cannot be sent and ends the run.
    """
    wanted, ranges = selection(ids), letters.ranges()
    done = raw.commits.state().runs.get(run_id)
    if done:
        return done["rows"]
    whole = decoded(letters.read(ranges).select("value", "partition", "offset"), DEAD_LETTER)
    opened = whole.select("partition", "offset", F.when(F.col("event.event").isNull(), F.raise_error(F.lit("a dead letter has no event"))).otherwise(F.col("event.event")).alias("event"))
    chosen = selected(opened, spark.createDataFrame([(i,) for i in wanted], "eventId string"), ranges)
    sent = republished(chosen, now, source, run_id=run_id, more=(F.col("partition").alias("_from"), F.col("offset").alias("_at"))).withColumn("ts", clock(now).cast("timestamp"))
    row = {k: str(v) for k, v in audit(chosen, run_id, source, now).first().asDict().items() if k != "run_id"}
    return raw.append(sent, run_id, ["_from", "_at"], row)


def by_offset(records: DataFrame, start: int, end: int) -> DataFrame:
    return records.where((F.col("offset") >= start) & (F.col("offset") < end))


def by_time(records: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    return records.where((F.col(ts) >= start) & (F.col(ts) < end))
