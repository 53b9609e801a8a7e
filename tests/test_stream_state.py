"""The change source, alerts with a hold time, state lookups, models that are swapped, the keyed sink, and recorded metrics."""

import os
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardlake.functions import cdc as C
from cardlake.operators import model as B
from cardlake.session import shared_folder
from cardlake.sources import avro, changes, keyed, tables
from cardlake.streaming import alerts, jobs, metrics, state

T0 = datetime(2024, 1, 1)
TABLE = "`__$start_lsn` binary, `__$seqval` binary, `__$operation` int, event_id long, at timestamp, note string"


def change(version, k):
    return (version.to_bytes(10, "big"), bytes([k % 256]), 2, k, T0 + timedelta(seconds=k), None if k % 3 else f"n{k}")


def table(spark, rows):
    return spark.createDataFrame(rows, TABLE)


def ids(df):
    return sorted(r.event_id for r in df.collect())


def test_changes_are_tailed_by_version(spark):
    path, out = shared_folder(spark, "table"), shared_folder(spark, "out")
    every = [change(v, k) for k, v in enumerate([0, 1, 1, 2, 255, 256, 2**16, 2**40, 2**79, 2**79 + 1])]
    schema = table(spark, []).schema
    read = lambda: jobs.run(changes.tail(spark, path, schema), "changes", out=out)
    assert read().count() == 0  # nothing there yet
    changes.write_changes(table(spark, every[:5]), path)
    assert ids(read()) == list(range(5))
    assert ids(read()) == list(range(5))  # nothing new
    changes.write_changes(table(spark, [*every[5:8], change(3, 50)]), path)  # a version that was read past isn't new
    assert ids(read()) == list(range(8))
    changes.write_changes(table(spark, every[8:]), path)
    got = read()
    assert ids(got) == list(range(10))
    assert sorted(map(str, ((bytes(r[0]), r.at, r.note) for r in got.collect()))) == sorted(str((r[0], r[4], r[5])) for r in every)
    later = jobs.run(changes.tail(spark, path, schema, start=(2**40).to_bytes(10, "big")), "later", out=shared_folder(spark, "later"))
    assert ids(later) == [8, 9]


def test_cleaned_up_versions_are_skipped(spark):
    path, out = shared_folder(spark, "table"), shared_folder(spark, "out")
    changes.write_changes(table(spark, [change(v, v) for v in range(1, 4)]), path)
    schema = table(spark, []).schema
    assert ids(jobs.run(changes.tail(spark, path, schema), "c", out=out)) == [1, 2, 3]
    local = path.removeprefix("file://")
    for name in os.listdir(local):
        os.remove(f"{local}/{name}")
    changes.write_changes(table(spark, [change(v, v) for v in range(8, 10)]), path)  # 4 to 7 are gone
    assert ids(jobs.run(changes.tail(spark, path, schema), "c", out=out)) == [1, 2, 3, 8, 9]


def test_a_batch_reads_the_row_groups_of_its_versions(spark):
    path = shared_folder(spark, "table")
    for part in range(4):
        changes.write_changes(table(spark, [change(100 * part + k, k) for k in range(100)]), path)
    reader = changes.ChangeReader(path, table(spark, []).schema, "")
    files = {p.path for p in reader.partitions({"version": ""}, reader.latestOffset())}
    some = reader.partitions({"version": (149).to_bytes(10, "big").hex()}, {"version": (199).to_bytes(10, "big").hex()})
    assert 0 < len({p.path for p in some}) <= len(files) // 4
    assert sum(b.num_rows for p in some for b in reader.read(p)) == 50


def test_envelopes_keep_their_version(spark):
    rows = table(spark, [change(7, 1)]).withColumns({"schema_version": F.lit("1.0.0"), "event_time": F.col("at"), "card_token": F.lit("t"), "user_id": F.lit("u"), "amount": F.lit(1.5), "currency": F.lit("USD"), "channel": F.lit("chip")})
    got = C.to_events(C.envelopes(rows, F.timestamp_seconds(F.lit(0)))).collect()
    assert [(r.lsn, r.reason, r.event_id) for r in got] == [((7).to_bytes(10, "big").hex(), None, "1")]


SAMPLE = "rule string, ts timestamp, value double"


def sample(rule, minute, value):
    return (rule, T0 + timedelta(minutes=minute), value)


def test_alerts_open_after_the_hold_and_close(spark):
    folder, out = shared_folder(spark, "samples"), shared_folder(spark, "held")
    schema = spark.createDataFrame([], SAMPLE).schema
    deliveries = [
        [sample("lag", 0, 900.0), sample("lag", 1, 900.0), sample("up", 0, 1.0), sample("short", 0, 900.0), sample("quiet", 0, 1.0)],
        [sample("lag", 2, 900.0), sample("lag", 5, 700.0), sample("short", 1, None), sample("still", 2, 900.0), sample("up", 5, 1.0)],
        [sample("up", 9, 1.0), sample("lag", 6, 10.0)],  # still has no more samples: the time that has passed opens it
        [sample("up", 20, 1.0), sample("lag", 21, 900.0), sample("lag", 22, 900.0), sample("lag", 23, 1.0)],
    ]
    seen = []
    with jobs.rocks(spark):
        for rows in deliveries:
            spark.createDataFrame(rows, SAMPLE).coalesce(1).write.mode("append").parquet(folder)
            s = jobs.source(spark, folder, schema, "ts")
            told = jobs.run(alerts.held(s, "ts", F.col("rule"), F.col("value") > 500, "2 minutes", "30 seconds"), "held", out=out)
            minute = lambda x: int((x.replace(tzinfo=None) - T0).total_seconds() // 60)
            seen.append({(r.rule, minute(r.since), minute(r.until), r.n, r.state) for r in alerts.alerts(told).collect()})
    assert seen[0] == set()
    assert ("lag", 0, 5, 4, "open") in seen[1] and {r[0] for r in seen[1]} <= {"lag", "still"}
    assert ("lag", 0, 5, 4, "closed") in seen[2]
    assert seen[3] == {("lag", 0, 5, 4, "closed"), ("still", 2, 2, 1, "open")}  # lag's second spell ended before the hold


EVENT = "event_id long, user_id long, ts timestamp_ntz, value double"


def deliver(spark, folder, *files):
    for f in files:
        spark.createDataFrame(f, EVENT).coalesce(1).write.mode("append").parquet(folder)


def events(n, of=3):
    return [(i, i % of, T0 + timedelta(minutes=i), float(i)) for i in range(n)]


def again(spark, out, batch):
    """As if a batch had failed before it was committed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/state/commits/{batch}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)


def test_state_is_looked_up_anew_for_each_batch(spark):
    folder, out = shared_folder(spark, "in"), shared_folder(spark, "out")
    known = state.Snapshots(shared_folder(spark, "state"), "user_id long, bonus double")
    r = events(9)
    deliver(spark, folder, r[:3], [*r[3:6], r[0]], r[6:])
    add = lambda n: known.add(spark.createDataFrame([(0, 10.0 * (n + 1))] + ([(1, 1.0)] if n else []), "user_id long, bonus double"), n)
    run = lambda: state.state_scoring(jobs.source(spark, folder, spark.createDataFrame([], EVENT).schema, "ts"), known, "user_id", lambda x: x.withColumn("fraud_probability", F.coalesce("bonus", F.lit(0.0))), 15.0, out, after=add)
    run()
    want = {(i, u, [0.0, 10.0, 20.0][i // 3] if u == 0 else 1.0 if u == 1 and i // 3 == 2 else 0.0) for i, u, *_ in r}
    got = spark.read.parquet(f"{out}/scored").collect()
    assert {(x.event_id, x.user_id, x.fraud_probability) for x in got} == want and len(got) == 9
    assert all(x.cold_card == (x.fraud_probability == 0) and x.decision == ("review" if x.fraud_probability >= 15 else "approve") for x in got)
    again(spark, out, 2)
    run()  # by now the state has changed again: the batch sees what it saw first
    assert {(x.event_id, x.user_id, x.fraud_probability) for x in spark.read.parquet(f"{out}/scored").collect()} == want


def test_models_are_swapped_between_batches(spark):
    folder, out, models = (shared_folder(spark, x) for x in ("in", "out", "models"))
    past = spark.createDataFrame([(float(i % 2), float(i % 3 == 0)) for i in range(60)], "odd double, third double")
    fit = lambda label: B.fit(past.withColumn("label", F.col(label)), ["odd", "third"], maxIter=2, maxDepth=2)
    B.save(fit("odd"), models, "a", threshold=0.5)
    r = events(12)
    deliver(spark, folder, r[:3], r[3:6], r[6:9], r[9:])
    inputs = lambda x: x.withColumns({"odd": (F.col("event_id") % 2).cast("double"), "third": (F.col("event_id") % 3 == 0).cast("double")})
    known = state.Snapshots(shared_folder(spark, "state"), "user_id long, n long")
    after = lambda n: B.save(fit("third"), models, "b", threshold=0.5) if n == 1 else None
    run = lambda: state.model_scoring(jobs.source(spark, folder, spark.createDataFrame([], EVENT).schema, "ts"), models, known, "user_id", inputs, out, after=after)
    run()
    want = {(i, "a" if i < 6 else "b", "review" if (i % 2 if i < 6 else i % 3 == 0) else "approve") for i in range(12)}
    read = lambda: {(x.event_id, x.model_version, x.decision) for x in spark.read.parquet(f"{out}/scored").collect()}
    assert read() == want
    B.save(fit("odd"), models, "c", threshold=0.5)
    again(spark, out, 3)
    run()  # not by the model that is current now
    assert read() == want


RECORD = T.StructType([T.StructField("event_id", T.LongType(), False), T.StructField("value", T.DoubleType(), False)])


def test_a_batch_of_records_is_whole_or_not_there(spark):
    folder, out, at = (shared_folder(spark, x) for x in ("in", "records", "at"))
    schema = spark.createDataFrame([], EVENT).schema
    columns = [F.col("event_id"), F.col("value")]
    wire = lambda s: keyed.keyed(s.drop("ts"), F.col("user_id"), avro.encode(RECORD, 3, *columns), avro.unwritable(RECORD, *columns))
    deliver(spark, folder, events(5), [(7, None, T0, 1.0), (8, 1, T0, None)])
    keyed.write(wire(jobs.source(spark, folder, schema, "ts")), out, at)
    values = lambda: sorted((r.key, r.r.event_id, r.r.value) for r in keyed.records(spark, out).select("key", avro.decode(RECORD, F.col("value"), 3).alias("r")).collect())
    want = sorted((str(u), i, v) for i, u, _, v in events(5))
    assert values() == want
    assert sorted((r.reason, r.raw) for r in keyed.rejects(spark, out).collect()) == [("key: is required", '{"event_id":7,"user_id":null,"value":1.0}'), ("value: is required", '{"event_id":8,"user_id":1,"value":null}')]
    assert [(r.batch, r.records, [(x.reason, x.n) for x in r.reasons]) for r in keyed.manifests(spark, out).orderBy("batch").collect()] == [(0, 5, []), (1, 0, [("key: is required", 1), ("value: is required", 1)])]

    @F.udf("binary")
    def fails(i):
        if i == 12:
            raise ValueError("lost")
        return b"x"

    deliver(spark, folder, [(i, 1, T0, 1.0) for i in range(9, 14)])
    broken = jobs.source(spark, folder, schema, "ts").drop("ts").repartition(3, "event_id")
    with pytest.raises(Exception, match="lost"):
        keyed.write(keyed.keyed(broken, F.col("user_id"), fails("event_id"), F.lit(None).cast("string")), out, at)
    assert values() == want and keyed.manifests(spark, out).count() == 2  # nothing of it is to be seen
    keyed.write(wire(jobs.source(spark, folder, schema, "ts")), out, at)
    assert values() == sorted([*want, *(("1", i, 1.0) for i in range(9, 14))])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/commits/2")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)
    keyed.write(wire(jobs.source(spark, folder, schema, "ts")), out, at)  # the batch again: its rows are there once
    assert len(values()) == 10


def test_an_aborted_batch_leaves_no_files(tmp_path):
    writer = keyed.KeyedWriter(f"file://{tmp_path}")
    rows = pa.record_batch([pa.array(["a", None]), pa.array([b"x", None]), pa.array([None, "{}"]), pa.array([None, "why"])], names=["key", "value", "raw", "reason"])
    told = writer.write(iter([rows, rows]))
    assert (told.records, told.reasons, len(told.files), len(told.rejects)) == (2, {"why": 2}, 1, 1)
    writer.abort([told, None], 0)
    assert not [f for _, _, names in os.walk(tmp_path) for f in names]


def test_queries_tell_what_they_do(spark):
    folder, told = shared_folder(spark, "in"), shared_folder(spark, "told")
    deliver(spark, folder, events(4), events(6))
    s = jobs.source(spark, folder, spark.createDataFrame([], EVENT).schema, "ts").observe("seen", F.count_if(F.col("value") > 2).alias("large"))
    with metrics.recorded(spark, told) as r:
        jobs.run(s, "told")
    assert not r.running
    got = {(x.batch, x.metric): x.value for x in spark.read.parquet(told).where("batch >= 0").collect()}
    assert {k: v for k, v in got.items() if k[1] in ("input_rows", "large")} == {(0, "input_rows"): 4.0, (1, "input_rows"): 6.0, (0, "large"): 1.0, (1, "large"): 3.0}
    assert (0, "batch_ms") in got
    with metrics.recorded(spark) as r, pytest.raises(Exception, match="sorry"):
        jobs.run(s.select(F.raise_error(F.lit("sorry")).cast("int").alias("x")), "fails")
    assert [x.metric for x in r.table().where("metric = 'failed'").collect()] == ["failed"]


def test_metrics_of_long_queries_are_written_on_the_way(spark, monkeypatch):
    monkeypatch.setattr(metrics, "FLUSH", 3)
    folder, told = shared_folder(spark, "in"), shared_folder(spark, "told")
    deliver(spark, folder, *(events(3) for _ in range(4)))
    with metrics.recorded(spark, told):
        jobs.run(jobs.source(spark, folder, spark.createDataFrame([], EVENT).schema, "ts"), "told")
    rows = spark.read.parquet(told)
    assert len(rows.inputFiles()) > 1
    assert rows.where("metric = 'input_rows'").agg(F.sum("value")).first()[0] == 12


def test_batches_are_tried_again(spark):
    folder = shared_folder(spark, "in")
    deliver(spark, folder, events(3), events(6))
    schema, calls = spark.createDataFrame([], EVENT).schema, []

    def flaky(rows, number):
        calls.append(number)
        if len(calls) in (1, 2):
            raise ConnectionError("busy")
        rows.count()

    jobs.foreach_batch(jobs.source(spark, folder, schema, "ts"), shared_folder(spark, "out"), flaky, attempts=3, wait=0.01)
    assert calls == [0, 0, 0, 1]
    calls.clear()
    with pytest.raises(Exception, match="busy"):
        jobs.foreach_batch(jobs.source(spark, folder, schema, "ts"), shared_folder(spark, "out"), flaky, attempts=2, wait=0.01)
    assert calls == [0, 0]

    def wrong(rows, number):
        calls.append(number)
        raise ValueError("bad row")

    calls.clear()
    with pytest.raises(Exception, match="bad row"):
        jobs.foreach_batch(jobs.source(spark, folder, schema, "ts"), shared_folder(spark, "out"), wrong, attempts=3, wait=0.01)
    assert calls == [0]


def test_batches_are_paced(spark):
    folder = shared_folder(spark, "in")
    deliver(spark, folder, events(3), events(3), events(3))
    begin = datetime.now()
    assert jobs.paced(jobs.source(spark, folder, spark.createDataFrame([], EVENT).schema, "ts"), "paced", "1 second").count() == 9
    assert datetime.now() - begin >= timedelta(seconds=2)


def test_appends_read_the_partitions_that_they_may_meet(spark):
    path = shared_folder(spark, "appended")
    df = lambda ids: spark.createDataFrame([(i, i // 10, "x") for i in ids], "id long, day long, note string")
    for ids in ([1, 2, 2, 15], [2, 3, 25], [], [15, 16, 99]):
        tables.append_new(df(ids), path, "id", by="day")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3, 15, 16, 25, 99]
