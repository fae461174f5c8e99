"""SQL for the registered queries, as another engine runs it."""

from __future__ import annotations

from ..functions.text import NON_SPACE
from ..operators.ingest import PAYLOAD_TEXTS, TEXTS
from ..schema import WIDTHS
from .fixtures import NOW, TELEMETRY


def trim(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '\A[\x00-\x20]+', ''), '[\x00-\x20]+\z', '')"


def has(c: str) -> str:
    return f"coalesce(regexp_matches({c}, '{NON_SPACE}'), false)"


def kept(c: str) -> str:
    return f"CASE WHEN {has(c)} THEN {trim(c)} ELSE {c} END"


def blank(c: str) -> str:
    return f"NOT coalesce({trim(c)} <> '', false)"


NOW_SQL = f"TIMESTAMP '{NOW}'"
TEL = "tel AS (" + TELEMETRY.format(q='"') + ")"
KEY = f"CASE WHEN {has('"eventId"')} THEN {trim('"eventId"')} WHEN {has('"tenantId"')} THEN {trim('"tenantId"')} END"
OUT = f"""{kept('"eventId"')} AS "eventId", {kept('"tenantId"')} AS "tenantId", '{{type}}' AS "eventType", coalesce("timestamp", {NOW_SQL}) AS "timestamp",
  'telemetry-processor' AS "source", CASE WHEN {has('version')} THEN {trim('version')} ELSE '1.0' END AS "version",
  {kept('"deviceId"')} AS "deviceId", {kept('"deviceType"')} AS "deviceType", {kept('metric')} AS "metric", "value", {kept('unit')} AS "unit", {kept('location')} AS "location" """
# ratios as whole numbers: ten-digit and tenth-of-a-percent values, rounded half up
SEEN = f"""seen AS (SELECT *, {trim('"tenantId"')} AS s_tenant, {trim('"deviceId"')} AS s_device, lower({trim('metric')}) AS s_metric FROM tel),
marked AS (SELECT *, {has('s_tenant')} AND {has('s_device')} AND {has('s_metric')} AND "value" IS NOT NULL AS complete FROM seen),
history AS (SELECT *, CASE WHEN complete THEN lag("value") OVER (PARTITION BY complete, s_tenant, s_device, s_metric ORDER BY seq) END AS previous FROM marked),
scaled AS (SELECT *, (abs("value" - previous) * 10000)::HUGEINT AS d, (abs(previous) * 10000)::HUGEINT AS q FROM history),
ratios AS (SELECT *, CASE WHEN q <> 0 THEN (d * 20000000000 + q) // (2 * q) END AS k FROM scaled),
reasoned AS (SELECT *, list_filter([
  CASE WHEN NOT {has('s_tenant')} THEN 'tenantId is required' END,
  CASE WHEN NOT {has('s_device')} THEN 'deviceId is required' END,
  CASE WHEN NOT {has('s_metric')} THEN 'metric is required' END,
  CASE WHEN "value" IS NULL THEN 'value is required' END,
  CASE WHEN complete AND s_metric = 'temperature' AND "value" > 80 THEN 'temperature is above maximum threshold' END,
  CASE WHEN complete AND s_metric = 'temperature' AND "value" < -40 THEN 'temperature is below minimum threshold' END,
  CASE WHEN k > 5000000000 THEN concat('value spike detected: changed by ',
    CAST(((k * 2000 + 10000000000) // 20000000000) // 10 AS VARCHAR), '.', CAST(((k * 2000 + 10000000000) // 20000000000) % 10 AS VARCHAR), '% from previous reading') END
  ], lambda r: r IS NOT NULL) AS reasons FROM ratios),
judged AS (SELECT *, len(reasons) > 0 AS anomalous, CASE WHEN len(reasons) = 0 THEN 'NONE' WHEN complete THEN 'WARNING' ELSE 'CRITICAL' END AS severity FROM reasoned)"""
COLUMN = {"event_id": '"eventId"', "tenant_id": '"tenantId"', "device_id": '"deviceId"', "device_type": '"deviceType"', "metric": "metric", "unit": "unit", "location": "location"}
BROKEN = "coalesce(" + ", ".join(
    part
    for name, width in WIDTHS.items()
    if name in COLUMN
    for part in (f"CASE WHEN {COLUMN[name]} IS NULL THEN 'constraint: {name} must not be null' END", f"CASE WHEN length({kept(COLUMN[name])}) > {width} THEN 'constraint: {name} is longer than {width}' END")
) + """, CASE WHEN "value" IS NULL THEN 'constraint: value must not be null' END)"""
ROUTED = f"""failed AS (SELECT *, CASE WHEN NOT has_payload THEN 'IllegalArgumentException: telemetry payload must not be null'
  WHEN anomalous THEN CASE WHEN {KEY} IS NULL THEN 'IllegalArgumentException: no usable message key' END ELSE {BROKEN} END AS error FROM judged),
routed AS (SELECT *, CASE WHEN error IS NOT NULL THEN CASE WHEN replayed THEN 'dropped_replay' ELSE 'dlq' END WHEN anomalous THEN 'anomaly' ELSE 'normal' END AS route FROM failed)"""
ROWS = f"""sent AS (SELECT seq, replayed, {OUT.replace('{type}', 'telemetry.processed')} FROM routed WHERE route = 'normal'),
rows_ AS (SELECT seq, replayed, "eventId" AS event_id, "tenantId" AS tenant_id, "eventType" AS event_type, "timestamp", "source", "deviceId" AS device_id, "deviceType" AS device_type,
  metric, "value"::DECIMAL(18,4) AS "value", unit, location, {NOW_SQL} AS ingested_at FROM sent)"""
STORED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY replayed DESC, CASE WHEN replayed THEN -seq ELSE seq END) AS place FROM rows_),
stored AS (SELECT * EXCLUDE (seq, replayed, place) FROM ranked WHERE place = 1)"""
LETTERS = f"""letters AS (SELECT *, {KEY} AS key, (seq % 2)::INTEGER AS "partition", seq // 2 AS "offset" FROM routed WHERE route = 'dlq')"""


def over(*parts: str) -> str:
    return "WITH " + ",\n".join([TEL, *parts]) + "\n"


CHOSEN = """ranges AS (SELECT "partition", min("offset") AS s, (min("offset") + max("offset") + 1) // 2 AS e FROM letters GROUP BY "partition"),
chosen AS (SELECT l.* FROM letters l JOIN ranges r USING ("partition")
WHERE l."offset" >= r.s AND l."offset" < r.e AND l."eventId" IN (SELECT "eventId" FROM letters WHERE "tenantId" IN ('tenant-1', 'tenant-2')))"""
ANOMALIES = f"""found AS (SELECT seq, replayed, {OUT.replace('{type}', 'telemetry.anomaly')}, severity, array_to_string(reasons, '; ') AS reasons FROM routed WHERE route = 'anomaly'),
placed AS (SELECT *, row_number() OVER (PARTITION BY "eventId" ORDER BY replayed DESC, CASE WHEN replayed THEN -seq ELSE seq END) AS place FROM found),
anomalies AS (SELECT "eventId" AS event_id, "tenantId" AS tenant_id, "deviceId" AS device_id, "timestamp", severity, reasons FROM placed WHERE place = 1)"""
BASE = over()
JUDGED = over(SEEN)
ROUTES = over(SEEN, ROUTED)
TABLE = over(SEEN, ROUTED, ROWS, STORED)
DEAD = over(SEEN, ROUTED, LETTERS)

_checks = [(f, blank(f'"{f}"')) for f in TEXTS] + [("timestamp", '"timestamp" IS NULL'), ("payload", "NOT has_payload")]
_checks += [(f"payload.{f}", "has_payload AND " + blank(f'"{f}"')) for f in PAYLOAD_TEXTS] + [("payload.value", 'has_payload AND "value" IS NULL')]


def _told(text) -> str:
    items = ", ".join(f"CASE WHEN {bad} THEN '{text(f)}' END" for f, bad in _checks)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), '; ')"


BAD = " OR ".join(f"({bad})" for _, bad in _checks)
FLAT = '"eventId", "tenantId", "eventType", "timestamp", "source", "version", "deviceId", "deviceType", metric, "value", unit, location'


def oracle_sql() -> dict[str, str]:
    return {
        "telemetry_normalized": BASE
        + f"""SELECT seq, {trim('"eventId"')} AS "eventId", {trim('"tenantId"')} AS "tenantId", lower({trim('"eventType"')}) AS "eventType", "timestamp", {trim('"source"')} AS "source",
  {trim('version')} AS "version", {trim('"deviceId"')} AS "deviceId", lower({trim('"deviceType"')}) AS "deviceType", lower({trim('metric')}) AS metric, "value", lower({trim('unit')}) AS unit,
  {trim('location')} AS location FROM tel WHERE has_payload""",
        "telemetry_outbound_processed": BASE + f"SELECT seq, {OUT.replace('{type}', 'telemetry.processed')} FROM tel WHERE has_payload",
        "ingest_violations": BASE + f"SELECT seq, {_told(lambda f: f)} AS fields, {_told(lambda f: f.split('.')[-1] + ' is required')} AS messages FROM tel WHERE {BAD}",
        "ingest_accepted": BASE + f"SELECT seq, {FLAT} FROM tel WHERE NOT ({BAD})",
        "ingest_malformed": "SELECT event_id FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 0",
        "message_key": BASE + f"SELECT seq, {KEY} AS key FROM tel",
        "anomaly_missing_fields": JUDGED + "SELECT seq, array_to_string(reasons, '; ') AS reasons FROM judged WHERE has_payload AND severity = 'CRITICAL'",
        "anomaly_temperature_bounds": JUDGED
        + """SELECT seq, "value", CASE WHEN "value" > 80 THEN 'temperature is above maximum threshold' ELSE 'temperature is below minimum threshold' END AS reason
FROM judged WHERE complete AND s_metric = 'temperature' AND ("value" > 80 OR "value" < -40)""",
        "anomaly_spike": JUDGED + """SELECT seq, previous, "value", reasons[-1] AS reason FROM judged WHERE k > 5000000000""",
        "anomaly_events": ROUTES
        + f"SELECT seq, {OUT.replace('{type}', 'telemetry.anomaly')}, severity, array_to_string(reasons, '; ') AS reasons, {NOW_SQL} AS \"detectedAt\" FROM routed WHERE route = 'anomaly'",
        "route_counts": ROUTES + "SELECT route, severity, count(*) AS n FROM routed GROUP BY route, severity",
        "severity_reasons": JUDGED + "SELECT severity, split_part(reason, ':', 1) AS reason, count(*) AS n FROM (SELECT severity, unnest(reasons) AS reason FROM judged WHERE has_payload) GROUP BY ALL",
        "stream_equals_batch": ROUTES
        + "SELECT seq, route AS batch_route, array_to_string(reasons, '; ') AS batch_reasons, route AS stream_route, array_to_string(reasons, '; ') AS stream_reasons FROM routed",
        "dead_letters": DEAD + f"""SELECT seq, key, "eventId", error AS "errorMessage", 'telemetry-processor' AS "sourceService", {NOW_SQL} AS "failedAt" FROM letters""",
        "processed_table": TABLE + "SELECT * FROM stored",
        "processed_topic_with_duplicates": TABLE + "SELECT event_id, count(*) AS n, count(*) FILTER (replayed) AS replays FROM rows_ GROUP BY event_id",
        "dlq_offset_ranges": DEAD + 'SELECT "partition", min("offset") AS start_offset, max("offset") + 1 AS end_offset FROM letters GROUP BY "partition"',
        "dlq_replay_selected": DEAD
        + """, ranges AS (SELECT "partition", min("offset") AS s, (min("offset") + max("offset") + 1) // 2 AS e FROM letters GROUP BY "partition")
SELECT l.key, 'true' AS replay, 'dlq' AS replay_source FROM letters l JOIN ranges r USING ("partition")
WHERE l."offset" >= r.s AND l."offset" < r.e AND l."eventId" IN (SELECT "eventId" FROM letters WHERE "tenantId" IN ('tenant-1', 'tenant-2'))""",
        "replay_loop_guard": ROUTES + "SELECT seq, route FROM routed WHERE error IS NOT NULL",
        "raw_replay_time_range": "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-09' AND event_id >= 100 AND event_id < 5000",
        "raw_retained": "SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS",
        "find_by_event_id": TABLE + "SELECT * FROM stored WHERE event_id = 'evt-89'",
        "dlq_count_by_event": DEAD + 'SELECT "eventId", count(*) AS n FROM letters GROUP BY "eventId"',
        "produced_not_consumed": TABLE + "SELECT seq FROM tel WHERE seq NOT IN (SELECT seq FROM rows_)",
        "request_rate_1m": "SELECT date_trunc('minute', ts)::TIMESTAMP AS window_start, count(*) AS n, count(*) / 60.0::DOUBLE AS per_second FROM events GROUP BY 1",
        "request_rate_by_job": "SELECT time_bucket(INTERVAL 2 MINUTES, ts, TIMESTAMP '1970-01-01')::TIMESTAMP AS window_start, event_type AS job, count(*) AS n, count(*) / 120.0::DOUBLE AS per_second FROM events GROUP BY 1, 2",
        "outcome_counts": ROUTES + "SELECT route AS outcome, count(*) AS n FROM routed GROUP BY route",
        "mean_latency": """SELECT event_type, sum(c)::BIGINT AS total, count(c) AS n, sum(c)::DOUBLE / count(c) AS mean FROM (SELECT event_type, round("value" * 100)::BIGINT AS c FROM events) GROUP BY event_type""",
        "counter_increase": """WITH s AS (SELECT event_type AS job, event_id % 1000 AS v, lag(event_id % 1000) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events)
SELECT job, sum(CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END)::BIGINT AS increase FROM s GROUP BY job""",
        "gauge_by_job": "SELECT event_type AS job, sum(user_id)::BIGINT AS total FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY event_type",
        "gauge_latest": """SELECT event_type AS job, max(event_id) AS ts, arg_max(user_id, event_id) AS "value" FROM events GROUP BY event_type""",
        "lag_by_topic": """WITH e AS (SELECT event_type AS topic, event_id % 3 AS p, max(event_id) + 1 AS e, max(event_id) FILTER (event_id % 5 <> 0) + 1 AS c FROM events GROUP BY 1, 2)
SELECT 'processors' AS consumergroup, topic, sum(c)::BIGINT AS committed, sum(greatest(e - c, 0))::BIGINT AS lag, count(*) FILTER (e > c) AS lagging FROM e WHERE c IS NOT NULL GROUP BY topic""",
        "assigned_partitions": "SELECT coalesce(count(*), 0)::BIGINT AS partitions FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error')",
        "traces_found": "SELECT event_id AS trace_id, ts FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-09' ORDER BY ts DESC, event_id LIMIT 50",
        "telemetry_by_tenant_recent": TABLE
        + """SELECT event_id, device_id, "timestamp", "value" FROM stored WHERE tenant_id = 'tenant-1' AND "timestamp" >= TIMESTAMP '2024-01-02' AND "timestamp" < TIMESTAMP '2024-01-09'
ORDER BY "timestamp" DESC, event_id LIMIT 100""",
        "device_latest": TABLE
        + """, last AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, device_id, metric ORDER BY "timestamp" DESC, event_id DESC) AS n FROM stored)
SELECT tenant_id, device_id, metric, "timestamp", "value", unit, event_id FROM last WHERE n = 1""",
        "metric_hourly": TABLE
        + """SELECT tenant_id, metric, date_trunc('hour', "timestamp")::TIMESTAMP AS window_start, count(*) AS n, min("value") AS least, max("value") AS greatest,
  sum("value")::DOUBLE / count(*) AS mean FROM stored GROUP BY 1, 2, 3""",
        "anomalies_by_tenant": ROUTES
        + f"""SELECT {kept('"tenantId"')} AS tenant_id, severity, count(*) AS n, max(coalesce("timestamp", {NOW_SQL})) AS last FROM routed WHERE route = 'anomaly' GROUP BY 1, 2""",
        "heartbeat_gaps": TABLE
        + """, steps AS (SELECT tenant_id, device_id, event_id, lag("timestamp") OVER (PARTITION BY tenant_id, device_id ORDER BY "timestamp", event_id) AS previous_at, "timestamp" FROM stored)
SELECT *, date_sub('second', previous_at, "timestamp") AS gap_seconds FROM steps WHERE date_sub('second', previous_at, "timestamp") > 3600""",
        "ingest_dead_letters": f"""SELECT event_id, NULL::VARCHAR AS key, CASE WHEN event_id % 97 = 0 THEN 'MalformedEvent: the line is no event' ELSE 'IllegalArgumentException: no usable message key' END AS "errorMessage",
  'ingestion-service' AS "sourceService", {NOW_SQL} AS "failedAt" FROM events WHERE event_id % 97 = 0 OR event_id % 83 = 0""",
        "replay_audit": over(SEEN, ROUTED, LETTERS, CHOSEN)
        + f"""SELECT 'run-1' AS run_id, 'dlq' AS source, {NOW_SQL} AS replayed_at, count(*) AS records, count(DISTINCT "eventId") AS events, min("offset") AS first_offset, max("offset") AS last_offset FROM chosen""",
        "counter_rate_2m": """WITH s AS (SELECT event_type AS job, ts, event_id % 1000 AS v, lag(event_id % 1000) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events),
grown AS (SELECT job, unnest([date_trunc('minute', ts)::TIMESTAMP, date_trunc('minute', ts)::TIMESTAMP - INTERVAL 1 MINUTE]) AS window_start, CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END AS i FROM s)
SELECT window_start, job, sum(i)::BIGINT AS increase, sum(i)::DOUBLE / 120 AS per_second FROM grown GROUP BY window_start, job""",
        "anomaly_table": over(SEEN, ROUTED, ANOMALIES) + "SELECT * FROM anomalies",
        "anomalies_recent": over(SEEN, ROUTED, ANOMALIES)
        + """SELECT event_id, device_id, "timestamp", severity, reasons FROM anomalies WHERE tenant_id = 'tenant-1' AND "timestamp" >= TIMESTAMP '2024-01-02' AND "timestamp" < TIMESTAMP '2024-01-09'
ORDER BY "timestamp" DESC, event_id LIMIT 100""",
        "first_dead_letter": DEAD + """SELECT "eventId", min(seq) AS seq, arg_min("partition", seq) AS "partition", arg_min("offset", seq) AS "offset", arg_min(error, seq) AS "errorMessage" FROM letters WHERE "eventId" IS NOT NULL GROUP BY "eventId\"""",
        "first_raw_record": BASE + f"SELECT {KEY} AS key, min(seq) AS seq, arg_min(replayed, seq) AS replayed FROM tel WHERE {KEY} IS NOT NULL GROUP BY 1",
        "dead_letters_by_key": DEAD + """SELECT key, seq, error AS "errorMessage" FROM letters WHERE key = 'evt-79'""",
        "table_after_batches": TABLE + "SELECT * FROM stored",
        "recent_from_layout": TABLE
        + """SELECT event_id, device_id, "timestamp", "value" FROM stored WHERE tenant_id = 'tenant-1' AND "timestamp" >= TIMESTAMP '2024-01-02' AND "timestamp" < TIMESTAMP '2024-01-09'
ORDER BY "timestamp" DESC, event_id LIMIT 100""",
        "raw_log_published": BASE + f"SELECT {FLAT} FROM tel WHERE NOT ({BAD}) AND {KEY} IS NOT NULL",
        "raw_log_by_offset": BASE + f"SELECT {FLAT} FROM tel WHERE NOT ({BAD}) AND {KEY} IS NOT NULL",
        "constraint_failures": """SELECT * FROM (SELECT event_id AS seq, CASE WHEN event_id % 53 > 50 THEN 'constraint: event_id is longer than 50' WHEN event_id % 103 > 100 THEN 'constraint: tenant_id is longer than 100'
  WHEN event_id % 107 > 100 THEN 'constraint: device_id is longer than 100' WHEN event_id % 109 > 100 THEN 'constraint: metric is longer than 100'
  WHEN event_id % 13 = 0 THEN 'constraint: unit must not be null' WHEN event_id % 23 > 20 THEN 'constraint: unit is longer than 20' WHEN event_id % 113 > 100 THEN 'constraint: location is longer than 100'
  WHEN event_id % 17 = 0 THEN 'constraint: value is out of range' END AS error FROM events) WHERE error IS NOT NULL""",
        "null_records": "SELECT event_type, count(*) AS records, count(*) FILTER (event_id % 103 = 0 OR props IS NULL) AS nulls FROM events GROUP BY event_type",
        "topics_caught_up": """WITH e AS (SELECT event_type AS topic, event_id % 3 AS p, max(event_id) + 1 AS e, max(event_id) FILTER (event_id % 5 <> 0) + 1 AS c FROM events GROUP BY 1, 2)
SELECT topic, bool_and(c >= e) AS all_match FROM e WHERE c IS NOT NULL GROUP BY topic""",
    }
