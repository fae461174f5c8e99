"""Decoding of event records, from files, logs and brokers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EVENT, RECORD


def decoded(records: DataFrame, schema: T.StructType = EVENT, value: str = "value") -> DataFrame:
    """Adds ``event`` (null where malformed) and ``malformed``; unknown fields are dropped.

    Both come out of a generator of one row, so that a line is parsed once however often later steps and filters name them.
    """
    corrupt = "_corrupt"
    parsed = F.from_json(F.col(value), T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})

    def told(p: Column) -> Column:
        malformed = p.isNull() | p[corrupt].isNotNull()
        return F.struct(malformed.alias("malformed"), F.when(~malformed, F.struct(*(p[f.name].alias(f.name) for f in schema.fields))).alias("event"))

    others = [F.col(f"`{c}`") for c in records.columns if c not in ("malformed", "event")]
    return records.select(*others, F.inline(F.transform(F.array(parsed), told)))


def null_counts(records: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """(by, records, nulls): how many records have no value at all; ``with_value`` leaves these out."""
    return records.groupBy(*by).agg(F.count("*").alias("records"), F.count_if(F.col(value).isNull()).alias("nulls"))


def with_value(records: DataFrame, value: str = "value") -> DataFrame:
    """Records with a value: a null record is no event and no dead letter, it is counted and left."""
    return records.where(F.col(value).isNotNull())


def header(headers: Column, key: str) -> Column:
    """The last header of this key, as text; null if there is none."""
    return F.try_element_at(F.filter(headers, lambda h: h["key"] == key), F.lit(-1))["value"].cast("string")


def is_replay(headers: Column, prefix: str = "telemetry") -> Column:
    return F.coalesce(F.lower(header(headers, f"{prefix}.replay")) == "true", F.lit(False))


def log(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """A log directory, as a table or as a stream."""
    if not stream:
        return spark.read.schema(RECORD).parquet(path)
    reader = spark.readStream.schema(RECORD)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def json_drop(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A directory into which producers put files of one JSON event a line."""
    return (spark.readStream if stream else spark.read).text(path).withColumn("headers", F.lit(None).cast(RECORD["headers"].dataType))


def kafka(spark: SparkSession, servers: str, topic: str, stream: bool = True, offsets_per_trigger: int | None = None, **options: str) -> DataFrame:
    """A broker's topic in the shape of ``RECORD``; needs Spark's connector on the class path."""
    reader = (spark.readStream if stream else spark.read).format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "includeHeaders": "true"} | options)
    if offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", offsets_per_trigger)
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "headers", "partition", "offset", F.col("timestamp").alias("ts"))


def offset_ranges(records: DataFrame) -> DataFrame:
    """(partition, start_offset, end_offset) of what a log holds; the end is exclusive."""
    return records.groupBy("partition").agg(F.min("offset").alias("start_offset"), (F.max("offset") + 1).alias("end_offset"))


def retained(records: DataFrame, now: Column, hours: int, ts: str = "ts") -> DataFrame:
    """Records younger than the log's retention; the bound reaches the scan."""
    return records.where(F.col(ts) >= now - F.expr(f"INTERVAL {int(hours)} HOURS"))
