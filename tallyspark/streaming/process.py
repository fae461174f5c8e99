"""Continuous processing: the batch operators in micro-batches, the previous reading in keyed state.

Only the spike rule needs history.  Complete readings pass a stateful operator
whose state is the last value of each tenant, device and metric, the keys dealt
over buckets; all else is the batch code.  A stream that goes on where a batch ended starts with the batch's last
readings as its state.  A micro-batch's logs go to folders named by its number and
are overwritten when it runs again, and the two tables take a number once, so a restart
repeats nothing.

A bucket's readings of one micro-batch are sorted in one task; the source's bound a
trigger (``maxOffsetsPerTrigger`` of ``sources.offsets``) bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.time import clock
from ..operators import detect, normalize, route, store
from ..schema import HEADERS
from ..sources import events as sources
from ..sources.log import Log
from ..sources.shared import folder

FIELDS = ["deviceId", "deviceType", "metric", "value", "unit", "location"]
# no leading underscores: the stateful operator would rename such columns
KEYS = ["k_tenant", "k_device", "k_metric"]
BUCKET = "k_bucket"


class LastValue(StatefulProcessor):
    """Adds the previous value of the key to each reading, in order of arrival.

    A call has the readings of all keys of a bucket, since frames cost more than rows; each key's value is an entry of its own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", ", ".join(f"{k} string" for k in KEYS), "value decimal(22,8)")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        readings = pd.concat(list(rows), ignore_index=True)
        number = readings.groupby(KEYS, sort=False).ngroup().to_numpy()
        order = np.lexsort((readings["seq"].to_numpy(), number))
        readings, number = readings.iloc[order], number[order]
        turn = np.flatnonzero(np.diff(number, prepend=-1, append=-1))  # where keys begin, and the end
        values = readings["k_value"].to_numpy()
        previous = np.empty(len(values), object)
        previous[1:] = values[:-1]
        names = readings[KEYS].iloc[turn[:-1]].itertuples(index=False, name=None)
        for name, lo, hi in zip(names, turn[:-1].tolist(), turn[1:].tolist(), strict=True):
            before = self.last.getValue(name)
            previous[lo] = before[0] if before else None
            self.last.updateValue(name, (values[hi - 1],))
        readings = readings.drop(columns=[BUCKET, *KEYS, "k_value"])
        readings["k_previous"] = previous
        yield readings

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for *name, value in initialState[[*KEYS, "k_value"]].itertuples(index=False, name=None):
            self.last.updateValue(tuple(name), (value,))

    def close(self) -> None:
        pass


def arrived(records: DataFrame, partitions: int) -> DataFrame:
    """(seq, replayed, the event's fields) of a raw log's records, in order of offset and then partition.

    Null records and lines that are no events are left out; ``sources.null_counts`` and ``ingest.dead_letters`` tell them.
    """
    opened = sources.decoded(sources.with_value(records)).where("not malformed")
    return opened.select((F.col("offset") * partitions + F.col("partition")).alias("seq"), sources.is_replay(F.col("headers")).alias("replayed"), "event.*")


def last_readings(events: DataFrame, order: str = "seq") -> DataFrame:
    """(keys, k_value): the last complete reading of each key of a batch, by a mergeable maximum."""
    seen = normalize.detection_view(events).where(detect.complete())
    flat = seen.select(order, F.col("seen.tenantId").alias("k_tenant"), F.col("seen.deviceId").alias("k_device"), F.col("seen.metric").alias("k_metric"), F.col("seen.value").cast("decimal(22,8)").alias("k_value"))
    return flat.groupBy(*KEYS).agg(F.max_by("k_value", order).alias("k_value"))


def with_previous(events: DataFrame, history: DataFrame | None = None, buckets: int = 512) -> DataFrame:
    """The stream's counterpart of the batch window: same columns, the history in state; ``history``: ``last_readings`` of what came before it.

    ``buckets`` deal out the keys and stay the same for the life of a checkpoint.
    """
    bucket = F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")
    seen = normalize.detection_view(events).withColumn("complete", detect.complete())
    plain = [c for c in events.columns if c != "payload"]
    flat = seen.select(*plain, "complete", F.col("payload").isNotNull().alias("k_payload"), *(F.col(f"payload.{f}").alias(f"p_{f}") for f in FIELDS), F.col("seen.tenantId").alias("k_tenant"), F.col("seen.deviceId").alias("k_device"), F.col("seen.metric").alias("k_metric"), F.col("seen.value").cast("decimal(22,8)").alias("k_value"))
    flat_names = [c for c in flat.columns if c not in (*KEYS, "k_value")]
    schema = ", ".join(f"`{c}` {flat.schema[c].dataType.simpleString()}" for c in flat_names) + ", k_previous decimal(22,8)"
    dealt = flat.where("complete").withColumn(BUCKET, bucket).groupBy(BUCKET)
    known = history.withColumn(BUCKET, bucket).groupBy(BUCKET) if history is not None else None
    whole = dealt.transformWithStateInPandas(LastValue(), schema, "append", "none", known)
    out = whole.union(flat.where("not complete").select(*flat_names, F.lit(None).cast("decimal(22,8)").alias("k_previous")))
    payload = F.when(F.col("k_payload"), F.struct(*(F.col(f"p_{f}").alias(f) for f in FIELDS)))
    back = out.select(*plain, payload.alias("payload"), "complete", F.col("k_previous").alias("previous"))
    return normalize.detection_view(back)


def write_outputs(base: str, now: Column | None = None, compact_every: int = 16, letters: Log | None = None):
    """A foreachBatch function: table rows first, then the anomalies' table and the three logs, then the routes of all events.

    With ``letters`` the dead letters go to that log, from which they can be replayed.
    """

    def write(batch: DataFrame, number: int) -> None:
        events = route.routed(detect.judged(batch), now).persist()
        good = events.where("route = 'normal'")
        odd = normalize.anomaly(events.where("route = 'anomaly'"), now, "seq", "replayed")
        tables = {"table": good.select("seq", "replayed", "row.*"), "anomaly_table": anomaly_rows(odd)}
        for name, rows in tables.items():
            kept = store.Table(batch.sparkSession, f"{base}/{name}")
            kept.append(rows, number)
            if number % compact_every == compact_every - 1:
                kept.compact()
        parts = {
            "processed": normalize.processed(good, now, "seq"),
            "anomalies": odd.drop("replayed"),
            "dlq": route.dead_letters(events, now, "seq") if letters is None else None,
            "routes": events.select("seq", F.col("route").alias("stream_route"), F.array_join("reasons", "; ").alias("stream_reasons")),
        }
        if letters is not None:
            sent = route.dead_letters(events, now, "seq").select("*", F.lit(0).alias("_from"), F.col("seq").alias("_at"))
            texts = route.rendered(sent, "_from", "_at").withColumns({"headers": F.lit(None).cast(HEADERS), "ts": clock(now).cast("timestamp")})
            letters.append(texts, f"batch-{number}", ["_from", "_at"])
            del parts["dlq"]
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(f"{base}/{name}/batch={number}")
        events.unpersist()

    return write


def anomaly_rows(anomalies: DataFrame) -> DataFrame:
    """Anomalies as rows of their table; of an event's deliveries it keeps the first, or the last replay."""
    return anomalies.select("seq", "replayed", F.col("eventId").alias("event_id"), F.col("tenantId").alias("tenant_id"), F.col("payload.deviceId").alias("device_id"), "timestamp", "severity", F.array_join("reasons", "; ").alias("reasons"))


def table(spark, base: str, name: str = "table") -> DataFrame:
    """The processed table (or ``anomaly_table``) as it stands: its base merged with the micro-batches since."""
    return store.Table(spark, f"{base}/{name}").read()


def start(events: DataFrame, base: str, now: Column | None = None, history: DataFrame | None = None, letters: Log | None = None, **trigger):
    """Starts the query; ``history`` as for ``with_previous``, ``letters`` as for ``write_outputs``, ``trigger`` as for ``DataStreamWriter.trigger``."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    writer = with_previous(events, history).writeStream.outputMode("append").foreachBatch(write_outputs(base, now, letters=letters)).option("checkpointLocation", f"{base}/checkpoint")
    return writer.trigger(**trigger or {"availableNow": True}).start()


def replayed_as_stream(events: DataFrame, now: Column, batches: int = 3) -> DataFrame:
    """(seq, stream_route, stream_reasons): the events written to a log in parts and read as a stream."""
    spark, base = events.sparkSession, folder(events.sparkSession)
    cuts = events.select(F.percentile_approx("seq", F.array(*(F.lit(n / batches) for n in range(1, batches))), 1000).alias("c")).first()["c"] or []
    bounds = [None, *cuts, None]
    # each part is what has arrived when the query runs again, in as many files as it was written in
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        part = events if lo is None else events.where(F.col("seq") > lo)
        (part if hi is None else part.where(F.col("seq") <= hi)).write.mode("append").parquet(f"{base}/log")
        start(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{base}/log"), f"{base}/out", now).awaitTermination()
    return spark.read.parquet(f"{base}/out/routes").drop("batch")
