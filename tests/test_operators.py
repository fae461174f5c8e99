from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import detect, ingest, metrics, normalize, replay, route, store
from tallyspark import schema
from tallyspark.schema import EVENT, WIDTHS
from tallyspark.sources import events as sources
from tallyspark.sources.commits import Conflict
from tallyspark.sources.log import Log

def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


SEQ = "seq bigint, replayed boolean, eventId string, tenantId string, eventType string, timestamp timestamp, source string, version string, payload " + EVENT["payload"].dataType.simpleString()


def event(seq, value="28.4", event_id=None, tenant="t", device="d", metric="temperature", replayed=False, unit="C", payload=True):
    p = (device, "kind", metric, None if value is None else Decimal(value), unit, "zone") if payload else None
    return (seq, replayed, event_id or f"e{seq}", tenant, "Telemetry.Reading", None, "src", "1.0", p)


def judged(spark, rows, span=7):
    seen = normalize.detection_view(spark.createDataFrame(rows, SEQ))
    return {r["seq"]: r for r in detect.judged(detect.with_previous(seen, span=span)).collect()}


def test_three_notions_of_blank(spark):
    rows = [(None,), ("",), (" \t",), (" ",), (" ",), (" a\u0001",), ("\u0000",)]
    got = spark.createDataFrame(rows, "x string").select(text.has_text(F.col("x")), text.not_blank(F.col("x")), text.trimmed(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [
        (False, False, None), (False, False, ""), (False, False, ""), (False, True, " "), (True, True, " "), (True, True, "a"), (True, False, ""),
    ]


@pytest.mark.parametrize(
    ("value", "metric", "reasons", "severity"),
    [
        ("28.4", "temperature", [], "NONE"),
        ("95.0", " Temperature ", ["temperature is above maximum threshold"], "WARNING"),
        ("-50.0", "temperature", ["temperature is below minimum threshold"], "WARNING"),
        ("80", "temperature", [], "NONE"),
        ("-40", "temperature", [], "NONE"),
        ("95.0", "pressure", [], "NONE"),
    ],
)
def test_rules(spark, value, metric, reasons, severity):
    got = judged(spark, [event(1, value, metric=metric)])[1]
    assert (got["reasons"], got["severity"], got["anomalous"]) == (reasons, severity, bool(reasons))


def test_missing_fields_come_in_order(spark):
    got = judged(spark, [event(1, None, tenant=None, device="", metric=None)])[1]
    assert got["reasons"] == ["tenantId is required", "deviceId is required", "metric is required", "value is required"]
    assert got["severity"] == "CRITICAL"


def test_spikes_follow_arrival(spark):
    rows = [event(1, "20"), event(2, "50"), event(3, None), event(4, "75"), event(5, "0"), event(6, "9"), event(7, "9.00000000036")]
    got = {k: r["reasons"] for k, r in judged(spark, rows).items()}
    assert got[2] == ["value spike detected: changed by 150.0% from previous reading"]
    assert got[4] == []  # exactly half above 50; the incomplete reading is no history
    assert got[5] == ["value spike detected: changed by 100.0% from previous reading"]
    assert got[6] == [] and got[7] == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.decimals(-90, 90, places=2)), min_size=1, max_size=60))
def test_spikes_equal_a_sequential_model(spark, readings):
    last, want = {}, {}
    for n, (device, value) in enumerate(readings):
        before, last[device] = last.get(device), value
        ratio = (abs(value - before) / abs(before)).quantize(Decimal("1e-10"), ROUND_HALF_UP) if before else None
        want[n] = ratio is not None and ratio > Decimal("0.5")
    got = judged(spark, [event(n, str(v), device=d, metric="m") for n, (d, v) in enumerate(readings)])
    assert {n: bool(r["reasons"]) for n, r in got.items()} == want


def test_routes_and_dead_letters(spark):
    rows = [event(1), event(2, payload=False), event(3, unit=None), event(4, unit=None, replayed=True), event(5, "99"), event(6, "99", event_id=" ", tenant="x" * 101), event(7, event_id="y" * 51, device="d7")]
    out = route.routed(detect.detected(normalize.detection_view(spark.createDataFrame(rows, SEQ))), now())
    got = {r["seq"]: (r["route"], r["error"]) for r in out.collect()}
    assert got[1] == ("normal", None)
    assert got[2] == ("dlq", route.NULL_PAYLOAD)
    assert got[3] == ("dlq", "constraint: unit must not be null")
    assert got[4] == ("dropped_replay", "constraint: unit must not be null")
    assert got[5][0] == got[6][0] == "anomaly"
    assert got[7] == ("dlq", f"constraint: event_id is longer than {WIDTHS['event_id']}")
    letters = route.rendered(route.dead_letters(out, now())).collect()
    assert {r["key"] for r in letters} == {"e2", "e3", "y" * 51}
    assert all('"errorMessage"' in r["value"] for r in letters)


def test_outbound_keeps_case_and_blank_text(spark):
    rows = [(1, False, " evt ", "  ", "x", None, "s", " ", (" Dev ", " K ", "  ", Decimal(1), None, "z"))]
    got = normalize.processed(spark.createDataFrame(rows, SEQ), now()).first()
    assert (got["eventId"], got["tenantId"], got["version"], got["eventType"]) == ("evt", "  ", "1.0", "telemetry.processed")
    assert tuple(got["payload"]) == ("Dev", "K", "  ", Decimal(1), None, "z")


def test_without_a_given_time_the_clock_tells_it(spark):
    """One time for all rows of a query, and none of it where the event has its own."""
    seen = normalize.detection_view(spark.createDataFrame([event(1), event(2, "99", device="d2"), event(3, unit=None, device="d3")], SEQ))
    out = route.routed(detect.detected(seen))
    before = spark.sql("SELECT current_timestamp()").first()[0]
    times = [normalize.processed(seen).select("timestamp"), normalize.anomaly(out).select("detectedAt"), route.dead_letters(out).select("failedAt"), out.where("route = 'normal'").select("row.ingested_at")]
    for found in times:
        got = {r[0] for r in found.collect()}
        assert len(got) == 1 and before <= got.pop()


def test_null_records_are_counted_and_left(spark):
    records = spark.createDataFrame([("a", "{}"), ("a", None), ("b", None), ("b", None)], "key string, value string")
    assert {tuple(r) for r in sources.null_counts(records, "key").collect()} == {("a", 2, 1), ("b", 2, 2)}
    assert sources.decoded(sources.with_value(records)).count() == 1


def test_fold_equals_a_sequential_model(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [(f"k{rng.randint(0, 40)}", n, rng.random() < 0.3, n * 10) for n in range(500)]
    table = {}
    for key, n, replayed, value in rows:
        if replayed or key not in table:
            table[key] = value
    frame = spark.createDataFrame(rows, "event_id string, seq bigint, replayed boolean, value bigint").repartition(7)
    assert {r["event_id"]: r["value"] for r in store.folded(frame).collect()} == table
    # the same in two batches
    kept = store.Table(spark, str(tmp_path / "table"), layout=("event_id",))
    for n, part in enumerate(("seq < 250", "seq >= 250")):
        kept.append(frame.where(part).withColumn("timestamp", now()), n)
    assert {r["event_id"]: r["value"] for r in kept.read().collect()} == table


def dead_letter_log(spark, path, letters, partitions=2):
    """A dead-letter log of (key, event id)."""
    rows = [(k, e, n) for n, (k, e) in enumerate(letters)]
    frame = spark.createDataFrame(rows, "key string, eventId string, _at bigint").withColumn("event", F.struct(F.struct("eventId", F.lit("t").alias("tenantId")).alias("event"), F.lit("why").alias("errorMessage")))
    log = Log(spark, path, partitions)
    log.append(frame.select("key", F.to_json("event").alias("value"), F.lit(None).cast(schema.HEADERS).alias("headers"), now().alias("ts"), F.lit(0).alias("_from"), "_at"), "fill", ["_from", "_at"])
    return log


def test_replay_takes_what_is_selected_and_in_range(spark, tmp_path):
    letters = dead_letter_log(spark, str(tmp_path / "dlq"), [("x", "a"), ("x", " a "), ("x", "b"), ("y", "a"), ("y", "c")])
    raw = Log(spark, str(tmp_path / "raw"), 3)
    assert sum(end - start for _, start, end in letters.ranges()) == 5
    assert replay.replay(spark, letters, ["a", None, " ", "a ", "c"], raw, now(), "run-1") == 3
    assert replay.replay(spark, letters, ["c", "b"], raw, now(), "run-2") == 2
    assert replay.replay(spark, letters, ["a", "b"], raw, now(), "run-2") == 2  # that run is done
    records = raw.read()
    found = records.select("partition", "offset", F.element_at("headers", 4)["value"].cast("string").alias("run")).collect()
    # offsets of both runs: from 0, without gaps or repetitions
    for p in {r["partition"] for r in found}:
        of_p = sorted((r["offset"], r["run"]) for r in found if r["partition"] == p)
        assert [o for o, _ in of_p] == list(range(len(of_p))) and [r for _, r in of_p] == sorted(r for _, r in of_p)
    runs = {r["run_id"]: r["info"] for r in raw.runs().collect()}
    assert set(runs) == {"run-1", "run-2"} and (runs["run-1"]["records"], runs["run-1"]["events"], runs["run-1"]["source"]) == ("3", "2", "dlq")
    assert [r[0] for r in records.select(sources.is_replay(F.col("headers"))).collect()] == [True] * 5
    with pytest.raises(ValueError):
        replay.selection([" ", None])


def test_replay_that_fails_leaves_nothing(spark, tmp_path, monkeypatch):
    """A crash between files and commit, another writer's commit in between, a letter without an event, a log without partitions."""
    letters = dead_letter_log(spark, str(tmp_path / "dlq"), [("x", "a"), ("y", "b")])
    raw = Log(spark, str(tmp_path / "raw"), 3)
    plain = raw.commits.commit

    def crash(*_, **__):
        raise RuntimeError("the driver is gone")

    monkeypatch.setattr(raw.commits, "commit", crash)
    with pytest.raises(RuntimeError):
        replay.replay(spark, letters, ["a"], raw, now(), "run-1")
    again = Log(spark, str(tmp_path / "raw"), 3)
    assert again.read().count() == 0 and again.commits._names("data")

    def late(*args, **more):
        replay.replay(spark, letters, ["b"], again, now(), "faster")
        return plain(*args, **more)

    monkeypatch.setattr(raw.commits, "commit", late)
    with pytest.raises(Conflict):
        replay.replay(spark, letters, ["a"], raw, now(), "run-1")
    assert {r["run_id"] for r in again.runs().collect()} == {"faster"} and again.read().count() == 1
    assert replay.replay(spark, letters, ["a"], again, now(), "run-1") == 1 and again.read().count() == 2
    assert len(again.commits.clean(hours=0)) == 2 and again.read().count() == 2  # of the crash and of the loser
    poison = Log(spark, str(tmp_path / "poison"), 1)
    poison.append(letters.read().select("key", F.lit('{"errorMessage":"no event"}').alias("value"), "headers", "ts", "partition", "offset").withColumnsRenamed({"partition": "_from", "offset": "_at"}), "fill", ["_from", "_at"])
    with pytest.raises(Exception, match="a dead letter has no event"):
        replay.replay(spark, poison, ["a"], again, now(), "run-3")
    with pytest.raises(ValueError, match="no partitions"):
        replay.replay(spark, Log(spark, str(tmp_path / "none")), ["a"], again, now(), "run-4")
    assert again.read().count() == 2


def test_records_appended_during_a_run_are_beyond_it(spark, tmp_path, monkeypatch):
    letters = dead_letter_log(spark, str(tmp_path / "dlq"), [("x", "a")], 1)
    ranges = letters.ranges()
    more = letters.read().select("key", "value", "headers", "ts", F.col("partition").alias("_from"), F.col("offset").alias("_at"))
    letters.append(more, "later", ["_from", "_at"])
    monkeypatch.setattr(letters, "ranges", lambda: ranges)
    assert letters.read().count() == 2
    assert replay.replay(spark, letters, ["a"], Log(spark, str(tmp_path / "raw"), 1), now(), "r") == 1


def test_decoding_tells_malformed_from_odd(spark):
    rows = [('{"eventId":"a","extra":1,"payload":{"value":28.4}}',), ('{"eventId"',), ('{"timestamp":"yesterday"}',), (None,)]
    got = sources.decoded(spark.createDataFrame(rows, "value string")).select("malformed", "event.eventId").collect()
    assert [tuple(r) for r in got] == [(False, "a"), (True, None), (True, None), (True, None)]


def test_a_line_is_parsed_once(spark):
    """However many rules and filters name the event, the plan has one parser."""
    lines = spark.createDataFrame([(1, "{}")], "offset int, value string")
    plan = ingest.dead_letters(sources.decoded(lines), now(), "offset")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_violations(spark):
    rows = [(1, False, None, "t", "e", None, "s", "v", ("", "k", "m", None, "u", "l")), (2, False, "e", "t", "e", None, "s", "v", None)]
    got = {r["seq"]: [v["field"] for v in r["violations"]] for r in ingest.validated(spark.createDataFrame(rows, SEQ)).collect()}
    assert got == {1: ["eventId", "timestamp", "payload.deviceId", "payload.value"], 2: ["timestamp", "payload"]}


def test_counters_survive_resets(spark):
    rows = [("a", 1, 10), ("a", 2, 15), ("a", 3, 4), ("b", 1, 7)]
    got = metrics.increases(spark.createDataFrame(rows, "job string, ts int, value int"), ["job"]).groupBy("job").agg(F.sum("increase")).collect()
    assert dict(map(tuple, got)) == {"a": 9, "b": 0}


def test_last_header_decides(spark):
    h = lambda *v: [("telemetry.replay", bytearray(x.encode())) for x in v]
    rows = [(h("true"),), (h("false", "TRUE"),), (h("true", "no"),), ([],), (None,)]
    got = spark.createDataFrame(rows, "headers array<struct<key:string,value:binary>>").select(sources.is_replay(F.col("headers"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False]


def test_files_to_logs_to_dead_letters(spark, tmp_path):
    """A drop of JSON lines becomes a log; the log's dead letters become a log; both are read back as records."""
    good = '{"eventId":"e1","tenantId":"t","eventType":"x","timestamp":"2026-03-31T12:00:00Z","source":"s","version":"1","payload":null}'
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.json").write_text(good + "\n{broken\n")
    lines = sources.json_drop(spark, str(drop)).withColumns({"key": F.lit("k"), "_from": F.lit(0), "_at": F.monotonically_increasing_id()})
    placed = replay.appended(lines, None, ["_from", "_at"], 3, span=2).withColumn("ts", F.current_timestamp())
    placed.select("key", "value", "headers", "partition", "offset", "ts").write.parquet(str(tmp_path / "raw"))
    log = sources.log(spark, str(tmp_path / "raw"))
    assert sorted(r["offset"] for r in log.collect()) == [0, 1]
    letters = ingest.dead_letters(sources.decoded(log), now(), "offset")
    rendered = route.rendered(letters).withColumns({"headers": F.lit(None).cast("array<struct<key:string,value:binary>>"), "partition": F.lit(0), "offset": F.lit(0).cast("long"), "ts": now().cast("timestamp")})
    rendered.write.parquet(str(tmp_path / "dlq"))
    back = sources.decoded(sources.log(spark, str(tmp_path / "dlq")), schema.DEAD_LETTER)
    assert [(r["event"]["errorMessage"], r["event"]["sourceService"], r["event"]["event"]) for r in back.collect()] == [("MalformedEvent: the line is no event", "ingestion-service", None)]


def test_described_errors(spark):
    got = spark.createDataFrame([("E", "m"), ("E", " "), (None, "m")], "e string, m string").select(ingest.described(F.col("e"), F.col("m"))).collect()
    assert [r[0] for r in got] == ["E: m", "E", "Unknown processing failure"]


def test_white_space_and_control_characters(spark):
    odd = ["", " ", "\u2003", "\u00a0", "\u2007", "\u202f", "\x00", "\x1c", "\x1b", " \u2003a ", "\x00 a\x1f", "\u3000\u1680\u2028", None]
    rows = spark.createDataFrame([(x,) for x in odd], "t string").select("t", text.has_text(F.col("t")).alias("has"), text.trimmed(F.col("t")).alias("trim"), F.coalesce(F.col("t").rlike(text.NON_SPACE), F.lit(False)).alias("by_pattern")).collect()
    for r in rows:
        assert r["has"] == r["by_pattern"], r
        assert r["trim"] == (None if r["t"] is None else r["t"].strip("".join(map(chr, range(33)))))
