"""Tables of base and deltas, logs by offset, and streams that go on where something ended."""

import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import ingest, metrics, query, replay
from tallyspark.operators.store import Table
from tallyspark.plans import queries
from tallyspark.plans.fixtures import now, telemetry
from tallyspark.sources import events as sources
from tallyspark.sources.commits import Commits, Conflict
from tallyspark.sources.log import STORED, Log, footer_ranges
from tallyspark.sources.offsets import OffsetLog
from tallyspark.streaming import process
from tallyspark.streaming.heartbeat import heartbeats

ROWS = "event_id string, seq bigint, replayed boolean, tenant_id string, device_id string, timestamp timestamp, value bigint"


def fold_by_hand(rows):
    out = {}
    for r in rows:
        if r[2] or r[0] not in out:
            out[r[0]] = r
    return out


def deliveries(n, keys, seed):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(keys)}", i, rng.random() < 0.2, f"t{rng.randrange(4)}", f"d{rng.randrange(9)}", dt.datetime(2026, 1, 1 + rng.randrange(6)), i * 10) for i in range(n)]


def scan_metric(df, name):
    """Sum of a metric over the file scans of a plan, after a run of it."""
    ran = df._jdf.queryExecution()
    ran.executedPlan().executeCollect()
    total, todo = 0, [ran.executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "FileSourceScanExec":
            total += node.metrics().get(name).get().value()
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_table_equals_the_fold_after_every_batch(spark, tmp_path, monkeypatch):
    rows, table = deliveries(600, 150, 1), Table(spark, str(tmp_path / "t"))
    for b in range(6):
        part = spark.createDataFrame(rows[b * 100 : (b + 1) * 100], ROWS)
        if b == 2:  # the writer is lost before its commit, and comes again
            plain = table.commits.commit
            monkeypatch.setattr(table.commits, "commit", lambda *_, **__: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                table.append(part, b)
            monkeypatch.setattr(table.commits, "commit", plain)
        changed = table.append(part, b)
        assert table.append(part, b) == changed  # the number is taken
        want = fold_by_hand(rows[: (b + 1) * 100])
        assert {r["event_id"]: r["value"] for r in table.read().collect()} == {k: r[-1] for k, r in want.items()}
        if b in (1, 3):
            table.compact()
            assert {r["event_id"]: r["value"] for r in table.read().collect()} == {k: r[-1] for k, r in want.items()}
    since, until = dt.datetime(2026, 1, 3), dt.datetime(2026, 1, 5)
    got = table.read(tenant="t1", device="d3", since=F.lit(since), until=F.lit(until))
    assert sorted(r["event_id"] for r in got.collect()) == sorted(k for k, r in want.items() if r[3] == "t1" and r[4] == "d3" and since <= r[5] < until)
    before = table.read().count()
    assert table.commits.clean(hours=0) and table.read().count() == before


def test_only_touched_days_are_rewritten(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    at = lambda day: dt.datetime(2026, 1, day)
    table.append(spark.createDataFrame([(f"e{n}", n, False, "t", "d", at(1 + n % 5), n) for n in range(50)], ROWS), 0)
    assert table.compact() == 5 and table.compact() == 0
    old = set(table.commits.state().entries)
    # a replay moves an event of day 2 to day 4: both are written, the other three stay
    table.append(spark.createDataFrame([("e1", 60, True, "t", "d", at(4), 99), ("e2", 61, False, "t", "d", at(3), 98), (None, 62, False, "t", "d", at(1), 0)], ROWS), 1)
    assert table.compact() == 2
    assert len(old & set(table.commits.state().entries)) == 3
    assert {r["value"] for r in table.read().where("event_id in ('e1', 'e2')").collect()} == {99, 2} and table.read().count() == 50


def test_layout_prunes_days_and_row_groups(spark, tmp_path):
    """A tenant's newest readings open the files of their days, and of those the ones that hold the tenant."""
    rows = spark.range(40_000).select(F.concat(F.lit("e"), "id").alias("event_id"), F.col("id").alias("seq"), F.lit(False).alias("replayed"), F.concat(F.lit("tenant-"), F.col("id") % 40).alias("tenant_id"), F.concat(F.lit("d"), F.col("id") % 400).alias("device_id"), F.timestamp_seconds(F.lit(1767225600) + F.floor(F.col("id") / 4000) * 86400).alias("timestamp"), F.col("id").alias("value"))
    table = Table(spark, str(tmp_path / "t"))
    table.append(rows, 0)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 500)
    try:
        assert table.compact() == 10
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    since, until = F.lit("2026-01-03").cast("timestamp"), F.lit("2026-01-05").cast("timestamp")
    whole, asked = table.read(), query.recent(table.read(tenant="tenant-7", since=since, until=until), 20)
    files, rows_read = (scan_metric(whole, n) for n in ("numFiles", "numOutputRows"))
    assert files >= 80 and scan_metric(asked, "numFiles") <= 0.25 * files  # two days of ten
    asked = query.recent(table.read(tenant="tenant-7", since=since, until=until), 20)
    assert scan_metric(asked, "numOutputRows") <= 0.05 * 40_000 <= rows_read  # and there the tenant's row groups
    assert len(asked.collect()) == 20 and {r["tenant_id"] for r in asked.collect()} == {"tenant-7"}


def test_commits_are_whole_and_one_writer_wins(spark, tmp_path):
    first, second = Commits(spark, str(tmp_path / "c"), whole_every=3), Commits(spark, str(tmp_path / "c"), whole_every=3)
    state = first.state()
    for n in range(7):
        state = first.commit(state, f"r{n}", [{"path": f"p{n}"}], [f"p{n - 2}"] if n > 1 else [], {"rows": n}, {"m": n})
    assert second.state() == state and set(state.entries) == {"p5", "p6"} and len(state.runs) == 7 and state.marks == {"m": 6}
    second.commit(second.state(), "other")
    with pytest.raises(Conflict):
        first.commit(state, "late")
    assert set(first.state().runs) - set(state.runs) == {"other"}


def records(spark, lo, hi, hour, keys=17):
    columns = [F.concat(F.lit("k"), F.col("id") % keys).alias("key"), F.concat(F.lit("v"), "id").alias("value"), F.when(F.col("id") % 2 == 0, F.array(F.struct(F.lit("h").alias("key"), F.lit("x").cast("binary").alias("value")))).alias("headers")]
    return spark.range(lo, hi, 1, 3).select(*columns, F.lit(f"2026-01-01 {hour:02d}:10:00").cast("timestamp").alias("ts"), F.lit(0).alias("_from"), F.col("id").alias("_at"))


def test_log_bounds_come_from_commits_and_footers(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"), 3)
    with pytest.raises(ValueError):
        log.ranges()
    assert log.append(records(spark, 0, 0, 1), "none", ["_from", "_at"]) == 0 and log.ranges() == [(p, 0, 0) for p in range(3)] and log.read().count() == 0
    assert log.append(records(spark, 0, 100, 1), "a", ["_from", "_at"]) == 100 == log.append(records(spark, 0, 100, 1), "a", ["_from", "_at"])
    log.append(records(spark, 100, 160, 2), "b", ["_from", "_at"])
    by_scan = sorted(tuple(r) for r in log.read().groupBy("partition").agg(F.min("offset"), F.max("offset") + 1).collect())
    assert log.ranges() == by_scan and log.read().count() == 160
    folder = next(iter(log.commits.state().entries)).split("/hour=")[0]
    stats = footer_ranges(spark, f"{tmp_path}/log/{folder}")
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(offset), MAX(offset), COUNT(*)]" in plan and STORED["offset"].name == "offset"
    assert sum(r["rows"] for r in stats.collect()) == 100
    part, start, end = log.ranges()[1]
    some = log.read([(part, start + 3, end - 2)])
    assert some.count() == end - start - 5


def test_expired_hours_go_and_offsets_stay(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"), 2)
    for n, hour in enumerate([1, 2, 3]):
        log.append(records(spark, n * 50, n * 50 + 50, hour), f"r{n}", ["_from", "_at"])
    ends = [(p, end) for p, _, end in log.ranges()]
    files = lambda: len(list((tmp_path / "log").rglob("*.parquet")))
    before = files()
    assert log.expire(dt.datetime(2026, 1, 2, 2, 59), 24) == 2  # the first hour; the second ended 23:59 ago
    assert [(p, end) for p, _, end in log.ranges()] == ends and log.read().count() == 100 and files() < before
    assert {r["value"] for r in log.read().collect()} == {f"v{n}" for n in range(50, 150)}
    log.expire(dt.datetime(2026, 2, 1), 24)
    assert log.ranges() == [(p, end, end) for p, end in ends] and files() == 0
    log.append(records(spark, 0, 10, 4), "next", ["_from", "_at"])
    assert all(start >= end for (_, start, _), (_, end) in zip(log.ranges(), ends, strict=True))


def test_offset_source_in_batches(spark, tmp_path):
    spark.dataSource.register(OffsetLog)
    log = Log(spark, str(tmp_path / "log"), 3)
    log.append(records(spark, 0, 90, 1), "a", ["_from", "_at"])
    log.append(records(spark, 90, 200, 2), "b", ["_from", "_at"])
    read = lambda **o: spark.read.format("offset_log").options(path=str(tmp_path / "log"), **o).load()
    plain = lambda df: sorted((r["partition"], r["offset"], r["key"], r["value"], str(r["headers"]), r["ts"]) for r in df.collect())
    assert plain(read()) == plain(log.read())
    (p, _, end), ranges = log.ranges()[2], log.ranges()
    wanted = plain(log.read([(p, 20, end - 1), *((q, s, e) for q, s, e in ranges if q != p)]))
    assert plain(read(startingOffsets=f'{{"{p}": 20}}', endingOffsets='{%s}' % ", ".join(f'"{q}": {e - (q == p)}' for q, _, e in ranges))) == wanted
    assert read(startingOffsets="latest").count() == 0
    with pytest.raises(Exception, match="no partition 9"):
        read(startingOffsets='{"9": 0}').count()
    log.expire(dt.datetime(2026, 1, 2, 2, 30), 24)
    with pytest.raises(Exception, match="are gone"):
        read(startingOffsets='{"0": 0, "1": 0, "2": 0}').count()
    assert plain(read(startingOffsets='{"0": 0, "1": 0, "2": 0}', failOnDataLoss="false")) == plain(log.read()) == plain(read())


def test_offset_stream_survives_restarts(spark, tmp_path):
    """Bounded triggers; stopped in the middle, killed between plan and sink, with appends in between: no record is lost or repeated."""
    spark.dataSource.register(OffsetLog)
    log, out, cp = Log(spark, str(tmp_path / "log"), 3), str(tmp_path / "out"), str(tmp_path / "cp")
    log.append(records(spark, 0, 130, 1), "a", ["_from", "_at"])
    sizes, fail = {}, []

    def sink(batch, number):
        n = batch.count()
        if fail and number == fail[0]:
            fail.clear()
            raise RuntimeError("killed")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        sizes[number] = n

    def run(wait):
        stream = spark.readStream.format("offset_log").options(path=str(tmp_path / "log"), maxOffsetsPerTrigger="30", checkpoint=cp).load()
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", cp).trigger(processingTime="0 seconds").start()
        until = time.time() + 60
        while time.time() < until and query.isActive and not wait():
            time.sleep(0.2)
        query.stop()

    run(lambda: len(sizes) >= 2)  # stopped early, perhaps within a batch
    fail.append(3)
    run(lambda: False)  # dies in batch 3, which is then planned but not written
    log.append(records(spark, 130, 160, 2), "b", ["_from", "_at"])
    run(lambda: sum(sizes.values()) >= 160)
    assert max(sizes.values()) <= 30 and sum(sizes.values()) == 160
    found = spark.read.parquet(out).select("partition", "offset", "value").collect()
    assert len(found) == 160 == len({(r["partition"], r["offset"]) for r in found}) and {r["value"] for r in found} == {f"v{n}" for n in range(160)}


def test_counter_segments_merge_in_any_grouping(spark):
    """A series with most samples, over many tasks and batches; increases by a sequential model."""
    rng, value, rows = random.Random(2), 0, []
    start = dt.datetime(2026, 1, 1)
    for n in range(6000):
        value = rng.randrange(3) if rng.random() < 0.01 else value + rng.randrange(5)
        rows.append(("hot", start + dt.timedelta(seconds=n // 3), n, value))
    rows += [(None, start, 0, 5), (None, start + dt.timedelta(seconds=90), 1, 9), ("lone", start, 0, 7), ("none", start, 0, None)]
    want, last = {}, {}
    for job, at, _, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if v is None:
            continue
        pane = at.replace(second=0)
        before = last.get(job)
        want[job, pane] = want.get((job, pane), 0) + (0 if before is None else v - before if v >= before else v)
        last[job] = v
    frame = spark.createDataFrame(rows, "job string, ts timestamp, n int, value bigint").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        segments = metrics.counter_segments(frame, ["job"], "60 seconds", ties=("n",))
        many = segments.where("job = 'hot'").count()
        got = metrics.merged_segments(segments, ["job"]).groupBy("job", "pane").agg(F.sum("increase").alias("increase")).collect()
        rates = metrics.counter_rate(frame, ["job"], "3 minutes", "2 minutes", ties=("n",)).where("job = 'hot'").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert many > 80
    assert {(r["job"], r["pane"].replace(tzinfo=None)): r["increase"] for r in got} == want
    for r in rates:
        panes = [r["window_start"].replace(tzinfo=None) + dt.timedelta(minutes=m) for m in range(3)]
        assert r["increase"] == sum(want.get(("hot", p), 0) for p in panes)


def test_stream_goes_on_where_a_batch_ended(spark, sf_dir, tmp_path):
    events = telemetry(spark, sf_dir)
    first, rest = events.where("seq < 500"), events.where("seq >= 500")
    rest.write.parquet(str(tmp_path / "log"))
    base = str(tmp_path / "out")
    process.start(spark.readStream.schema(events.schema).parquet(str(tmp_path / "log")), base, now(), process.last_readings(first)).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{base}/routes").select("seq", "stream_route", "stream_reasons").collect())
    whole = queries.routed(spark, sf_dir).where("seq >= 500").select("seq", "route", F.array_join("reasons", "; "))
    assert got == sorted(tuple(r) for r in whole.collect())


def test_one_call_has_all_keys_of_a_bucket():
    """Previous values by key and order over several frames; one read and one write of state a key."""
    state, asked = {("t", "d", "heat"): (5,)}, []

    class Values:
        def getValue(self, key):
            asked.append(key)
            return state.get(key)

        def updateValue(self, key, value):
            state[key] = value

    class Handle:
        def getMapState(self, *_):
            return Values()

    processor = process.LastValue()
    processor.init(Handle())
    rows = [(4, "d", "heat", 8), (1, "e", "heat", 1), (3, "d", "heat", 7), (2, "d", "wet", 9), (5, "e", "heat", 2)]
    frame = pd.DataFrame([(0, seq, "t", device, metric, value) for seq, device, metric, value in rows], columns=["k_bucket", "seq", *process.KEYS, "k_value"])
    (got,) = processor.handleInputRows((0,), iter([frame[:2], frame[2:]]), None)
    assert dict(zip(got["seq"].tolist(), got["k_previous"].tolist(), strict=True)) == {1: None, 2: None, 3: 5, 4: 7, 5: 1}
    assert list(got.columns) == ["seq", "k_previous"]
    assert state == {("t", "d", "heat"): (8,), ("t", "e", "heat"): (2,), ("t", "d", "wet"): (9,)} and len(asked) == 3


def test_streamed_tables_equal_the_batch(spark, sf_dir, tmp_path):
    """The processed and the anomaly table after several runs of the stream, replays of both kinds included."""
    events, base = telemetry(spark, sf_dir), str(tmp_path / "out")
    for lo, hi in ((0, 500), (500, 10**9 + 500), (10**9 + 500, 10**10)):
        events.where(F.col("seq").between(lo, hi - 1)).write.mode("append").parquet(str(tmp_path / "log"))
        process.start(spark.readStream.schema(events.schema).parquet(str(tmp_path / "log")), base, now()).awaitTermination()
    plain = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert plain(process.table(spark, base).drop("seq", "replayed")) == plain(queries.processed_table(spark, sf_dir))
    assert plain(process.table(spark, base, "anomaly_table").drop("seq", "replayed")) == plain(queries.anomaly_table(spark, sf_dir))


def test_rows_are_stored_before_anything_is_sent(spark, sf_dir, tmp_path, monkeypatch):
    """If the table cannot take a batch, no log has it either; the batch's second run writes all, once."""
    events, base = telemetry(spark, sf_dir).where("seq < 200"), str(tmp_path / "out")
    judged = queries.judged(spark, sf_dir).where("seq < 200")
    write, plain = process.write_outputs(base, now()), Table.append
    monkeypatch.setattr(Table, "append", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        write(judged.drop("reasons", "anomalous", "severity"), 0)
    assert not (tmp_path / "out" / "processed").exists() and not (tmp_path / "out" / "dlq").exists()
    monkeypatch.setattr(Table, "append", plain)
    for _ in range(2):
        write(judged.drop("reasons", "anomalous", "severity"), 0)
    assert spark.read.parquet(f"{base}/routes").count() == events.count()
    normal = queries.rows(spark, sf_dir).where("seq < 200").select("event_id").distinct().count()
    assert process.table(spark, base).count() == normal


def test_from_publishing_to_replay_and_back(spark, sf_dir, tmp_path):
    """Accepted events go to the raw log, by offset through the stream to tables and dead letters, and chosen letters back to the raw log.

    A replay that fails again is dropped, so the dead-letter log does not grow; the payload that comes back is the one that was sent.
    """
    spark.dataSource.register(OffsetLog)
    raw, letters, base = Log(spark, str(tmp_path / "raw"), 2), Log(spark, str(tmp_path / "dlq"), 1), str(tmp_path / "out")
    events = telemetry(spark, sf_dir).where("seq < 120").withColumns({"_from": F.lit(0), "eventId": F.when(F.col("seq") % 40 == 1, F.concat("eventId", F.lit("x" * 60))).otherwise(F.col("eventId"))})
    sent = ingest.publish(events, raw, "run-1", ["_from", "seq"], now())
    assert sent == ingest.publish(events, raw, "run-1", ["_from", "seq"], now()) == raw.read().count()

    def run():
        records = spark.readStream.format("offset_log").options(path=str(tmp_path / "raw")).load()
        process.start(process.arrived(records, 2), base, now(), letters=letters).awaitTermination()
        return {r["seq"]: r["stream_route"] for r in spark.read.parquet(f"{base}/routes").collect()}

    routes = run()
    assert len(routes) == sent
    failed = letters.read()
    ids = [r[0] for r in failed.select(F.get_json_object("value", "$.event.eventId")).collect()]
    assert ids and len(ids) == sum(r == "dlq" for r in routes.values()) and all(i.endswith("x" * 60) for i in ids)
    rows = process.table(spark, base).count()
    assert replay.replay(spark, letters, ids[:1], raw, now(), "again") == 1 == replay.replay(spark, letters, ids[:1], raw, now(), "again")
    back = sources.decoded(raw.read()).where(F.col("event.eventId") == ids[0]).select("event", sources.is_replay(F.col("headers")).alias("replayed")).collect()
    assert sorted(r["replayed"] for r in back) == [False, True] and back[0]["event"] == back[1]["event"]
    routes = run()
    assert len(routes) == sent + 1 and [r for s, r in routes.items() if r == "dropped_replay"] == ["dropped_replay"]
    assert letters.read().count() == len(ids) and process.table(spark, base).count() == rows


def test_heartbeats_of_a_stream(spark, tmp_path):
    """Gaps as in the batch whatever the order of arrival, and the devices that fall silent, once."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, start = random.Random(3), dt.datetime(2026, 1, 1)
    rows = [("t", f"d{rng.randrange(5)}", f"e{n}", start + dt.timedelta(seconds=n * 7 + rng.randrange(300), microseconds=rng.randrange(10**6))) for n in range(400)]
    rows = [r for r in rows if r[1] != "d4" or r[3] < start + dt.timedelta(seconds=1000)]
    rows.append(("t", "last", "x", start + dt.timedelta(days=1)))
    kinds = "tenant_id string, device_id string, event_id string, timestamp timestamp"
    base = str(tmp_path)
    for part in (rows[:200], rows[200:]):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(f"{base}/in")
        found = heartbeats(spark.readStream.schema(kinds).parquet(f"{base}/in"), 100)
        found.writeStream.option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).format("parquet").option("path", f"{base}/out").start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    want = query.heartbeat_gaps(spark.createDataFrame(rows, kinds), 100)
    assert sorted(tuple(r) for r in out.where("not silent").drop("silent").collect()) == sorted(tuple(r) for r in want.collect())
    ends = {}
    for _, d, _, at in rows:
        ends[d] = max(at, ends.get(d, at))
    ended = [(r["device_id"], r["previous_at"]) for r in out.where("silent").collect()]
    assert {e for e in ended if e[1] == ends[e[0]]} == {(d, at) for d, at in ends.items() if d != "last"} and len(ended) == len(set(ended))
