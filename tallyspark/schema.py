"""Schemas of events and tables, names of logs, and how long logs keep records."""

from __future__ import annotations

from pyspark.sql import types as T

PAYLOAD = T.StructType(
    [
        T.StructField("deviceId", T.StringType()),
        T.StructField("deviceType", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DecimalType(22, 8)),
        T.StructField("unit", T.StringType()),
        T.StructField("location", T.StringType()),
    ]
)
EVENT = T.StructType(
    [
        T.StructField("eventId", T.StringType()),
        T.StructField("tenantId", T.StringType()),
        T.StructField("eventType", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("payload", PAYLOAD),
    ]
)
HEADERS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]))
#: A record of a log: what a topic of a broker holds.
RECORD = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("headers", HEADERS),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
DEAD_LETTER = T.StructType(
    [
        T.StructField("event", EVENT),
        T.StructField("errorMessage", T.StringType()),
        T.StructField("sourceService", T.StringType()),
        T.StructField("failedAt", T.TimestampType()),
    ]
)
#: Longest text of each column of the processed table; all are required.
WIDTHS = {"event_id": 50, "tenant_id": 100, "event_type": 50, "source": 100, "device_id": 100, "device_type": 100, "metric": 100, "unit": 20, "location": 100}
#: Log: (partitions, hours kept).
LOGS = {"raw": (3, 24), "processed": (3, 168), "anomalies": (3, 168), "dlq": (1, 168)}
SERVICE = "telemetry-processor"
INGESTION = "ingestion-service"
