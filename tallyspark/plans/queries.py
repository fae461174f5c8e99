"""The engine's registered queries; ``oracles`` has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, ingest, metrics, normalize, query, replay, route, store
from ..schema import EVENT
from ..sources import events as sources
from ..sources.log import Log
from ..sources.offsets import OffsetLog
from ..sources.shared import folder, saved
from ..streaming import process
from .fixtures import now, table, telemetry

ENVELOPE = ["eventId", "tenantId", "eventType", "timestamp", "source", "version"]
PAYLOAD = [f"payload.{f}" for f in ("deviceId", "deviceType", "metric", "value", "unit", "location")]


def week():
    """Start and end of the time range that some queries ask for."""
    return [F.lit(day).cast("timestamp_ntz") for day in ("2024-01-02 00:00:00", "2024-01-09 00:00:00")]


def seen(spark, d):
    return normalize.detection_view(telemetry(spark, d))


def judged(spark, d):
    return detect.detected(seen(spark, d))


def routed(spark, d):
    return route.routed(judged(spark, d), now())


def rows(spark, d):
    """Rows for the processed table, duplicates and replays included."""
    return routed(spark, d).where("route = 'normal'").select("seq", "replayed", "row.*")


def stored(spark, d):
    return store.folded(rows(spark, d))


def letters(spark, d):
    """A dead-letter log of two partitions, its offsets by order of arrival."""
    out = route.dead_letters(routed(spark, d), now(), "seq")
    return out.withColumn("partition", (F.col("seq") % 2).cast("int")).withColumn("offset", F.floor(F.col("seq") / 2).cast("long"))


def telemetry_normalized(spark, d):
    return seen(spark, d).where("payload is not null").select("seq", "seen.*")


def telemetry_outbound_processed(spark, d):
    return normalize.processed(telemetry(spark, d).where("payload is not null"), now(), "seq").select("seq", *ENVELOPE, *PAYLOAD)


def ingest_violations(spark, d):
    bad = ingest.validated(telemetry(spark, d)).where("status = 400")
    return bad.select("seq", F.array_join("violations.field", "; ").alias("fields"), F.array_join("violations.message", "; ").alias("messages"))


def ingest_accepted(spark, d):
    return ingest.validated(telemetry(spark, d)).where("status = 202").select("seq", *ENVELOPE, *PAYLOAD)


def ingest_malformed(spark, d):
    """Event lines as JSON, some cut short and some with a time that is none."""
    e = table(spark, d, "events")
    at = F.when(F.col("event_id") % 89 == 0, F.lit("yesterday")).otherwise(F.lit("2026-03-31T12:00:00Z"))
    whole = F.concat(F.lit('{"eventId":"evt-'), F.col("event_id"), F.lit('","timestamp":"'), at, F.lit('","extra":1,"payload":{"value":'), F.col("value"), F.lit("}}"))
    lines = e.select("event_id", F.when(F.col("event_id") % 97 == 0, F.lit('{"eventId": ')).otherwise(whole).alias("value"))
    return sources.decoded(lines, EVENT).where("malformed").select("event_id")


def message_key(spark, d):
    return telemetry(spark, d).select("seq", ingest.message_key(F.col("eventId"), F.col("tenantId")).alias("key"))


def anomaly_missing_fields(spark, d):
    critical = judged(spark, d).where("payload is not null and severity = 'CRITICAL'")
    return critical.select("seq", F.array_join("reasons", "; ").alias("reasons"))


def anomaly_temperature_bounds(spark, d):
    found = judged(spark, d).select("seq", F.col("seen.value").alias("value"), F.explode("reasons").alias("reason"))
    return found.where(F.col("reason").startswith("temperature is"))


def anomaly_spike(spark, d):
    found = judged(spark, d).select("seq", "previous", F.col("seen.value").alias("value"), F.explode("reasons").alias("reason"))
    return found.where(F.col("reason").startswith("value spike"))


def anomaly_events(spark, d):
    good = routed(spark, d).where("route = 'anomaly'")
    out = normalize.anomaly(good, now(), "seq")
    return out.select("seq", *ENVELOPE, *PAYLOAD, "severity", F.array_join("reasons", "; ").alias("reasons"), "detectedAt")


def route_counts(spark, d):
    return routed(spark, d).groupBy("route", "severity").agg(F.count("*").alias("n"))


def severity_reasons(spark, d):
    """The flagship: how often each rule fires, by severity; a spike's percentage is left out."""
    found = judged(spark, d).where("payload is not null").select("severity", F.explode("reasons").alias("reason"))
    return found.groupBy("severity", F.split("reason", ":")[0].alias("reason")).agg(F.count("*").alias("n"))


def dead_letters(spark, d):
    out = route.dead_letters(routed(spark, d), now(), "seq")
    return out.select("seq", "key", F.col("event.eventId").alias("eventId"), "errorMessage", "sourceService", "failedAt")


def processed_table(spark, d):
    return stored(spark, d).drop("seq", "replayed")


def processed_topic_with_duplicates(spark, d):
    out = rows(spark, d)
    return out.groupBy("event_id").agg(F.count("*").alias("n"), F.count_if("replayed").alias("replays"))


def dlq_offset_ranges(spark, d):
    return sources.offset_ranges(letters(spark, d))


def _chosen(spark, d):
    """All dead letters of tenants 1 and 2, in the lower half of each partition."""
    log = saved(letters(spark, d))  # read three times
    ids = log.where(F.col("event.tenantId").isin("tenant-1", "tenant-2")).select("event.eventId")
    ranges = [(p, start, (start + end) // 2) for p, start, end in replay.snapshot(log)]
    return replay.selected(log, ids, ranges)


def dlq_replay_selected(spark, d):
    out = replay.republished(_chosen(spark, d).withColumn("seq", F.col("seq")), now())
    return out.select("key", F.element_at("headers", 1)["value"].cast("string").alias("replay"), F.element_at("headers", 3)["value"].cast("string").alias("replay_source"))


def replay_loop_guard(spark, d):
    """Failures that come from a replay: told apart from dead letters, by header."""
    marked = telemetry(spark, d).withColumn("headers", F.when(F.col("replayed"), replay.headers(now())).otherwise(F.array().cast("array<struct<key:string,value:binary>>")))
    marked = marked.withColumn("replayed", sources.is_replay(F.col("headers"))).drop("headers")
    out = route.routed(detect.detected(normalize.detection_view(marked)), now())
    return out.where("error is not null").select("seq", "route")


def raw_replay_time_range(spark, d):
    e = table(spark, d, "events").select("event_id", "ts").withColumn("offset", F.col("event_id"))
    return replay.by_offset(replay.by_time(e, *week()), 100, 5000).select("event_id", "ts")


def raw_retained(spark, d):
    e = table(spark, d, "events")
    latest = e.agg(F.max("ts").alias("latest"))  # one row
    return sources.retained(e.join(F.broadcast(latest)), F.col("latest"), 24).select("event_id", "ts")


def find_by_event_id(spark, d):
    return query.by_event_id(stored(spark, d), "evt-89").drop("seq", "replayed")


def dlq_count_by_event(spark, d):
    return letters(spark, d).groupBy(F.col("event.eventId").alias("eventId")).agg(F.count("*").alias("n"))


def produced_not_consumed(spark, d):
    produced = telemetry(spark, d).select("seq")
    return metrics.missing(produced, rows(spark, d), "seq")


def request_rate_1m(spark, d):
    return metrics.rate(table(spark, d, "events"), "1 minute")


def request_rate_by_job(spark, d):
    return metrics.rate(table(spark, d, "events").withColumnRenamed("event_type", "job"), "2 minutes", ("job",))


def outcome_counts(spark, d):
    return metrics.outcomes(routed(spark, d).withColumnRenamed("route", "outcome"), "outcome")


def mean_latency(spark, d):
    e = table(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return metrics.mean_latency(e, F.col("cents"), "event_type")


def counter_increase(spark, d):
    """Counters that go back to zero every 1,000 events."""
    e = table(spark, d, "events").select(F.col("event_type").alias("job"), F.col("event_id").alias("ts"), (F.col("event_id") % 1000).alias("value"))
    return metrics.increases(e, ["job"], chunk=F.floor(F.col("ts") / 3000)).groupBy("job").agg(F.sum("increase").alias("increase"))


def gauge_by_job(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("job"), F.col("user_id").alias("value"))
    return metrics.gauge_sum(e, "^(click|error|view)$")


def gauge_latest(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("job"), F.col("event_id").alias("ts"), F.col("user_id").alias("value"))
    return metrics.latest(e, ["job"])


def _committed(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 3).cast("int").alias("partition"), F.col("event_type").alias("topic"), "event_id")
    ends = e.groupBy("topic", "partition").agg((F.max("event_id") + 1).alias("end_offset"))
    done = e.where("event_id % 5 <> 0").groupBy("topic", "partition").agg((F.max("event_id") + 1).alias("committed"))
    return ends, done.withColumn("consumergroup", F.lit("processors"))


def lag_by_topic(spark, d):
    return metrics.lag_by_topic(*_committed(spark, d))


def assigned_partitions(spark, d):
    e = table(spark, d, "events")
    members = e.groupBy(F.col("user_id").alias("member")).agg(F.count("*").alias("partitions"))
    return metrics.assigned(members, e.where("event_type = 'error'").select(F.col("user_id").alias("member")))


def traces_found(spark, d):
    tag = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    spans = table(spark, d, "events").select(F.col("event_id").alias("trace_id"), "ts", F.lit("ingestion-service").alias("service"), F.array(tag("kind", F.col("event_type"))).alias("tags"))
    return metrics.traces(spans, "ingestion-service", *week(), 50, kind="click").select("trace_id", "ts")


def telemetry_by_tenant_recent(spark, d):
    start, end = week()
    return query.recent(stored(spark, d), 100, tenant="tenant-1", since=start, until=end).select("event_id", "device_id", "timestamp", "value")


def device_latest(spark, d):
    return query.device_latest(stored(spark, d))


def metric_hourly(spark, d):
    return query.summed_by_window(stored(spark, d), "1 hour", "tenant_id", "metric")


def anomalies_by_tenant(spark, d):
    good = routed(spark, d).where("route = 'anomaly'")
    out = normalize.anomaly(good, now(), "seq")
    return out.groupBy(F.col("tenantId").alias("tenant_id"), "severity").agg(F.count("*").alias("n"), F.max("timestamp").alias("last"))


def heartbeat_gaps(spark, d):
    return query.heartbeat_gaps(stored(spark, d), 3600)


def stream_equals_batch(spark, d):
    """Routes of the batch and of the stream over the same events; both columns agree."""
    batch = routed(spark, d).select("seq", F.col("route").alias("batch_route"), F.array_join("reasons", "; ").alias("batch_reasons"))
    return batch.join(process.replayed_as_stream(telemetry(spark, d), now()), "seq", "full")


def ingest_dead_letters(spark, d):
    """Event lines as JSON: some cut short, some rejected, and some whose ids are white space that only a key's rule knows."""
    e = table(spark, d, "events")
    name = F.when(F.col("event_id") % 83 == 0, F.lit("\u2003")).when(F.col("event_id") % 89 == 0, F.lit(" ")).otherwise(F.concat(F.lit("evt-"), "event_id"))
    tenant = F.when(F.col("event_id") % 83 == 0, F.lit("\u2003")).otherwise(F.lit("tenant-1"))
    payload = F.struct(*(F.lit("x").alias(f) for f in ("deviceId", "deviceType", "metric", "unit", "location")), F.lit(1).alias("value"))
    event = F.struct(name.alias("eventId"), tenant.alias("tenantId"), *(F.lit("x").alias(f) for f in ("eventType", "source", "version")), F.lit("2026-03-31T12:00:00Z").alias("timestamp"), payload.alias("payload"))
    lines = e.select("event_id", F.when(F.col("event_id") % 97 == 0, F.lit('{"eventId": ')).otherwise(F.to_json(event)).alias("value"))
    out = ingest.dead_letters(sources.decoded(lines, EVENT), now(), "event_id")
    return out.select("event_id", "key", "errorMessage", "sourceService", "failedAt")


def replay_audit(spark, d):
    return replay.audit(_chosen(spark, d), "run-1", " dlq ", now())


def counter_rate_2m(spark, d):
    """Counters that go back to zero every 1,000 events, over two minutes, each minute."""
    e = table(spark, d, "events").select(F.col("event_type").alias("job"), "ts", "event_id", (F.col("event_id") % 1000).alias("value"))
    return metrics.counter_rate(e, ["job"], "2 minutes", "1 minute", ties=("event_id",))


def _anomaly_table(spark, d):
    """Anomalies with one row for each event: the first delivery, or the last replay."""
    good = routed(spark, d).where("route = 'anomaly'")
    out = normalize.anomaly(good, now(), "seq", "replayed")
    return store.folded(out.select("seq", "replayed", F.col("eventId").alias("event_id"), F.col("tenantId").alias("tenant_id"), F.col("payload.deviceId").alias("device_id"), "timestamp", "severity", F.array_join("reasons", "; ").alias("reasons")))


def anomaly_table(spark, d):
    return _anomaly_table(spark, d).drop("seq", "replayed")


def anomalies_recent(spark, d):
    start, end = week()
    return query.recent(_anomaly_table(spark, d), 100, tenant="tenant-1", since=start, until=end).select("event_id", "device_id", "timestamp", "severity", "reasons")


def first_dead_letter(spark, d):
    found = letters(spark, d).select(F.col("event.eventId").alias("eventId"), "seq", "partition", "offset", "errorMessage")
    return query.first_by(found, "eventId", ["seq"])


def first_raw_record(spark, d):
    raw = telemetry(spark, d).select(ingest.message_key(F.col("eventId"), F.col("tenantId")).alias("key"), "seq", "replayed")
    return query.first_by(raw, "key", ["seq"])


def dead_letters_by_key(spark, d):
    return query.by_key(letters(spark, d), "evt-79").select("key", "seq", "errorMessage")


def _kept(spark, d):
    """The processed table written in four batches by order of arrival, with a compaction after the second."""
    whole, table_ = saved(rows(spark, d)), store.Table(spark, folder(spark))
    middle = table(spark, d, "events").agg(F.max("event_id")).first()[0] // 2
    for number, (lo, hi) in enumerate([(0, middle), (middle, 10**9), (10**9, 2 * 10**9), (2 * 10**9, 10**10)]):
        table_.append(whole.where((F.col("seq") >= lo) & (F.col("seq") < hi)), number)
        if number == 1:
            table_.compact()
    return table_


def table_after_batches(spark, d):
    """Base and deltas, merged: equal to the fold over all deliveries."""
    return _kept(spark, d).read().drop("seq", "replayed")


def recent_from_layout(spark, d):
    """The newest readings of a tenant from the table's days and row groups, its last two batches not yet compacted."""
    start, end = week()
    return query.recent(_kept(spark, d).read(tenant="tenant-1", since=start, until=end), 100).select("event_id", "device_id", "timestamp", "value")


def _raw(spark, d):
    """A raw log of the accepted events."""
    log = Log(spark, folder(spark), 3)
    ingest.publish(telemetry(spark, d).withColumn("_from", F.lit(0)), log, "run-1", ["_from", "seq"], now())
    return log


def _opened(records):
    found = sources.decoded(sources.with_value(records)).select("event.*")
    return found.select(*ENVELOPE[:3], F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), *ENVELOPE[4:], *(F.col(p).cast("decimal(18,4)").alias("value") if p == "payload.value" else p for p in PAYLOAD))


def raw_log_published(spark, d):
    """Accepted events, published to the raw log and read back."""
    return _opened(_raw(spark, d).read())


def raw_log_by_offset(spark, d):
    """The same log by (partition, offset): the first hundred of each partition, and all that follow."""
    spark.dataSource.register(OffsetLog)
    path, hundred = _raw(spark, d).path, '{"0": 100, "1": 100, "2": 100}'
    reader = lambda **bounds: spark.read.format("offset_log").options(path=path, **bounds).load()
    return _opened(reader(endingOffsets=hundred).union(reader(startingOffsets=hundred)))


def constraint_failures(spark, d):
    """Rows whose texts grow beyond the table's widths, and values beyond its digits."""
    e = table(spark, d, "events")
    long = lambda c, n: F.expr(f"repeat('{c}', cast(event_id % {n} as int))")
    value = F.when(F.col("event_id") % 17 == 0, F.lit(10).cast("decimal(16,0)") * F.lit("10000000000000").cast("decimal(16,0)")).otherwise(F.col("event_id"))
    texts = {"event_id": long("e", 53), "tenant_id": long("t", 103), "event_type": F.lit("x"), "source": F.lit("s"), "device_id": long("d", 107), "device_type": F.lit("k"), "metric": long("m", 109), "unit": F.when(F.col("event_id") % 13 != 0, long("u", 23)), "location": long("l", 113)}
    built = e.select(F.col("event_id").alias("seq"), *(c.alias(k) for k, c in texts.items()), value.cast("string").try_cast("decimal(18,4)").alias("value"), F.lit(True).alias("_had_value"))
    return built.select("seq", route.constraint_failure().alias("error")).where("error is not null")


def null_records(spark, d):
    e = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 103 != 0, F.col("props")).alias("value"))
    return sources.null_counts(e, "event_type")


def topics_caught_up(spark, d):
    ends, done = _committed(spark, d)
    return metrics.all_match(done.join(ends, ["topic", "partition"]), F.col("committed") >= F.col("end_offset"), "topic")


NAMES = [
    telemetry_normalized, telemetry_outbound_processed, ingest_violations, ingest_accepted, ingest_malformed, message_key, anomaly_missing_fields, anomaly_temperature_bounds,
    anomaly_spike, anomaly_events, route_counts, severity_reasons, dead_letters, processed_table, processed_topic_with_duplicates, dlq_offset_ranges, dlq_replay_selected,
    replay_loop_guard, raw_replay_time_range, raw_retained, find_by_event_id, dlq_count_by_event, produced_not_consumed, request_rate_1m, request_rate_by_job, outcome_counts,
    mean_latency, counter_increase, gauge_by_job, gauge_latest, lag_by_topic, assigned_partitions, traces_found, telemetry_by_tenant_recent, device_latest, metric_hourly,
    anomalies_by_tenant, heartbeat_gaps, stream_equals_batch, ingest_dead_letters, replay_audit, counter_rate_2m, anomaly_table, anomalies_recent, first_dead_letter, first_raw_record,
    dead_letters_by_key, topics_caught_up, table_after_batches, recent_from_layout, raw_log_published, raw_log_by_offset, constraint_failures, null_records,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMES}
