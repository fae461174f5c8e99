"""Rates, increases and lags over counters and event logs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .history import with_last

SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def increases(samples: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", chunk: Column | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``increase`` since the series' previous sample; after a reset the counter starts at 0. No extrapolation.

    ``chunk``: pieces of time (never falling as time rises) into which a long series is cut; ``ties``: the order of samples of one time.
    """
    out = with_last(samples, {k: F.col(k) for k in keys}, [ts, *ties], value, F.lit(0) if chunk is None else chunk, "previous")
    return out.withColumn("increase", step(F.col(value), F.col("previous"))).drop("previous")


def rate(events: DataFrame, window: str = "1 minute", keys: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """Events a second in each window, by keys."""
    counted = events.groupBy(F.window(ts, window).alias("w"), *keys).agg(F.count("*").alias("n"))
    seconds = (F.unix_micros(F.col("w.end").cast("timestamp")) - F.unix_micros(F.col("w.start").cast("timestamp"))) / 1e6
    return counted.select(F.col("w.start").alias("window_start"), *keys, "n", (F.col("n") / seconds).alias("per_second"))


def seconds_of(duration: str) -> int:
    """Of a duration like ``2 minutes``."""
    number, unit = duration.split()
    return int(number) * SECONDS[unit.rstrip("s")]


def step(value: Column, last: Column) -> Column:
    """What a counter grew by since its last value; after a reset it starts at 0."""
    return F.when(last.isNull(), F.lit(0)).when(value >= last, value - last).otherwise(value)


def counter_segments(samples: DataFrame, keys: list[str], pane: str, ts: str = "ts", value: str = "value", ties: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pane, first_at, first, last, increase, n): stretches of a counter in one pane of time.

    The samples are dealt by ranges of (keys, time), so a series of any length lies in as many
    tasks as its samples fill, and each task makes segments of what it has in order; a
    batch's end ends a segment too.  Two segments that follow one another are one
    again by ``merged_segments``, in any grouping.  ``first_at`` is a struct of time and ties.
    """
    whole = isinstance(samples.schema[value].dataType, T.IntegralType)
    kind = "bigint" if whole else "double"
    start = F.window(ts, pane)["start"]
    rows = samples.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(*keys, start.alias("pane"), F.struct(ts, *ties).alias("first_at"), F.col(value).cast(kind).alias("value"))
    ordered = rows.repartitionByRange(*keys, "first_at").sortWithinPartitions(*keys, "first_at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in range(len(keys) + 1):
                codes = batch.column(c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            v = batch.column(len(keys) + 2).to_numpy(zero_copy_only=False)
            grown = np.where(v[1:] >= v[:-1], v[1:] - v[:-1], v[1:])
            grown = np.where(new, 0, np.concatenate([v[:1], grown])).astype(v.dtype)
            first = np.flatnonzero(new)
            after = np.append(first[1:], batch.num_rows)
            heads = batch.take(pa.array(first))
            counted = [pa.array(x) for x in (v[first], v[after - 1], np.add.reduceat(grown, first), after - first)]
            yield pa.RecordBatch.from_arrays([*heads.columns[:-1], *counted], [*keys, "pane", "first_at", "first", "last", "increase", "n"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields[:-1])
    return ordered.mapInArrow(cut, f"{fields}, first {kind}, last {kind}, increase {kind}, n bigint")


def merged_segments(segments: DataFrame, keys: list[str], chunk: Column | None = None) -> DataFrame:
    """Segments with what the counter grew by since the segment before: their sum over any of a series' segments is its increase there.

    ``chunk``: pieces of time (never falling as time rises) into which a long series' segments are cut.
    """
    out = with_last(segments, {k: F.col(k) for k in keys}, ["first_at"], "last", F.to_date("pane") if chunk is None else chunk, "carried")
    return out.withColumn("increase", F.col("increase") + step(F.col("first"), F.col("carried"))).drop("carried")


def counter_rate(samples: DataFrame, keys: list[str], window: str, slide: str, ts: str = "ts", value: str = "value", ties: tuple[str, ...] = ()) -> DataFrame:
    """A counter's increase a second in each sliding window, resets and all, by keys: from segments, one or few a pane and series."""
    pane = f"{math.gcd(seconds_of(window), seconds_of(slide))} seconds"
    panes = merged_segments(counter_segments(samples, keys, pane, ts, value, ties), keys).groupBy("pane", *keys).agg(F.sum("increase").alias("increase"))
    summed = panes.groupBy(F.window("pane", window, slide).alias("w"), *keys).agg(F.sum("increase").alias("increase"))
    return summed.select(F.col("w.start").alias("window_start"), *keys, "increase", (F.col("increase") / seconds_of(window)).alias("per_second"))


def all_match(rows: DataFrame, condition: Column, *keys: str) -> DataFrame:
    """Whether a condition holds for every row of a key; unknown counts as not."""
    return rows.groupBy(*keys).agg(F.bool_and(F.coalesce(condition, F.lit(False))).alias("all_match"))


def outcomes(events: DataFrame, outcome: str) -> DataFrame:
    return events.groupBy(outcome).agg(F.count("*").alias("n"))


def mean_latency(events: DataFrame, latency: Column, *keys: str) -> DataFrame:
    """Sum of latencies over their number."""
    return events.groupBy(*keys).agg(F.sum(latency).alias("total"), F.count(latency).alias("n")).withColumn("mean", F.col("total") / F.col("n"))


def gauge_sum(samples: DataFrame, jobs: str, value: str = "value") -> DataFrame:
    """Sum of a gauge by job, for jobs that match a pattern."""
    return samples.where(F.col("job").rlike(jobs)).groupBy("job").agg(F.sum(value).alias("total"))


def latest(samples: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """The last sample of each series, by a mergeable maximum."""
    others = [c for c in samples.columns if c not in keys]
    return samples.groupBy(*keys).agg(F.max_by(F.struct(*others), ts).alias("s")).select(*keys, "s.*")


def lag_by_topic(ends: DataFrame, committed: DataFrame) -> DataFrame:
    """(consumergroup, topic, committed, lag, lagging): sums over partitions, and how many lag behind."""
    joined = committed.join(ends, ["topic", "partition"])
    behind = F.greatest(F.col("end_offset") - F.col("committed"), F.lit(0))
    return joined.groupBy("consumergroup", "topic").agg(F.sum("committed").alias("committed"), F.sum(behind).alias("lag"), F.count_if(behind > 0).alias("lagging"))


def assigned(members: DataFrame, ready: DataFrame) -> DataFrame:
    """Partitions that ready members have been given."""
    return members.join(ready.select("member").distinct(), "member", "left_semi").agg(F.coalesce(F.sum("partitions"), F.lit(0)).alias("partitions"))


def missing(produced: DataFrame, consumed: DataFrame, key: str) -> DataFrame:
    """What was produced and not consumed."""
    return produced.join(consumed.select(key).distinct(), key, "left_anti")


def traces(spans: DataFrame, service: str, start: Column, end: Column, limit: int, **tags: str) -> DataFrame:
    """The newest traces of a service in a time range with all these tags."""
    found = spans.where((F.col("service") == service) & (F.col("ts") >= start) & (F.col("ts") < end))
    for k, v in tags.items():
        wanted = F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))
        found = found.where(F.array_contains("tags", wanted))
    return found.orderBy(F.desc("ts"), "trace_id").limit(limit)
