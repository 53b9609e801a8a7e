import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardlake.functions import cdc as CDC
from cardlake.functions import events as E
from cardlake.functions import expr as X
from cardlake.functions import schema as S
from cardlake.operators import dimensions as D
from cardlake.operators import metrics as M
from cardlake.operators import model
from cardlake.operators import ordered as O
from cardlake.operators import windows as W
from cardlake.session import shared_folder
from cardlake.sources import avro, tables


@pytest.mark.parametrize("frame", [0, 60, W.FRAME])
def test_windows_with_ties_and_edges(spark, frame):
    """All keys by changes, some, none."""
    rng = random.Random(1)
    t0 = datetime(2024, 1, 1)
    rows = [(i, rng.choice([0, 1, 1, 1, 2, 2]), t0 + timedelta(seconds=rng.choice([0, 3600, 3600 * rng.randint(0, 2000), rng.randint(0, 40) * 86400])), round(rng.random() * 100, 2), rng.random() < 0.2, rng.choice("abc")) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k int, t timestamp_ntz, amount double, bad boolean, city string")
    got = {r.id: r for r in W.trailing(df, "k", "t", "id", "amount", F.col("bad"), "city", frame=frame).collect()}
    for i, k, t, *_, city in rows:
        for name, w in W.WINDOWS.items():
            past = [r for r in rows if r[1] == k and (r[2], r[0]) < (t, i) and (t - r[2]).total_seconds() <= w]
            g = got[i]
            assert g[f"txn_count_{name}"] == len(past)
            assert abs(g[f"amount_sum_{name}"] - sum(r[3] for r in past)) < 1e-6
            assert g[f"distinct_city_{name}"] == len({r[5] for r in past})
            assert abs(g[f"decline_rate_{name}"] - (sum(r[4] for r in past) / len(past) if past else 0)) < 1e-9
        assert got[i]["is_new_city_30d"] == (city not in {r[5] for r in past})


def test_first_event_and_gap(spark):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "a", t0), (2, "a", t0 + timedelta(seconds=300)), (3, "a", t0 + timedelta(days=90))], "id long, k string, t timestamp_ntz")
    for stream in (0, W.STREAM):
        got = [r.time_since_last_txn_s for r in W.since_last(df, "k", "t", "id", stream).orderBy("id").collect()]
        assert got == [W.CAP, 300.0, W.CAP]
        got = [r.running_count for r in W.running_totals(df.withColumn("x", F.lit(1.0)), "k", "t", "id", "x", stream).orderBy("id").collect()]
        assert got == [1, 2, 3]


def test_running_over_ranges(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, 0.5, *map(float, range(50))]), i % 7) for i in range(500)]
    df = O.in_ranges(spark.createDataFrame(rows, "id long, k int, v double, x long"), "v")
    assert df.select(O.RANGE).distinct().count() > 1  # so that a key is divided
    for down in (False, True):
        sign = -1 if down else 1
        by = [F.desc_nulls_last("v") if down else F.asc_nulls_first("v"), F.asc("id")]
        got = {r.id: (r.total, r.most) for r in O.running(O.running(df, ["k"], by, {"x": "total"}, downward=down), ["k"], by, {"x": "most"}, F.max, downward=down).collect()}
        at = lambda r: (sign * (float("-inf") if r[2] is None else r[2]), r[0])
        for r in rows:
            before = [q[3] for q in rows if q[1] == r[1] and at(q) < at(r)]
            assert got[r[0]] == ((sum(before), max(before)) if before else (None, None))


def test_edges_of_windows(spark):
    """Nulls in key, city and amount; an event exactly as old as the window; an empty table."""
    t0 = datetime(2024, 1, 1)
    rows = [(1, None, t0, 1.0, "a"), (2, None, t0 + timedelta(hours=1), None, None), (3, None, t0 + timedelta(hours=1, microseconds=1), 2.0, "a"), (4, 7, t0, 5.0, "b")]
    df = spark.createDataFrame(rows, "id long, k int, t timestamp_ntz, amount double, city string")
    for frame in (0, W.FRAME):
        of = lambda d: W.trailing(d, "k", "t", "id", "amount", F.lit(False), "city", {"1h": 3600}, frame=frame)  # noqa: B023, E731
        got = {r.id: (r.txn_count_1h, r.amount_sum_1h, r.distinct_city_1h, r.is_new_city_1h) for r in of(df).collect()}
        assert got == {1: (0, 0.0, 0, True), 2: (1, 1.0, 1, None), 3: (1, 0.0, 0, True), 4: (0, 0.0, 0, True)}
        assert of(df.limit(0)).count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([(2999,), (3000,), (3999,), (4000,), (4829,)], "mcc int")
    assert [r[0] for r in df.select(X.mcc_group(F.col("mcc"))).collect()] == ["other", "travel", "travel", "other", "cash"]
    row = spark.createDataFrame([("$-54.00", "2023", "2", "30", "14:06", None)], "a string, y string, m string, d string, h string, n string")
    c = F.col
    got = row.select(X.money(c("a")), X.event_time(c("y"), c("m"), c("d"), c("h")), X.mask_token(c("n")), X.zip_code(F.lit("85719.0")), X.country(F.lit("chip"), F.lit("Italy"))).first()
    assert tuple(got) == (-54.0, None, "…unknown", "85719", "IT")


def test_contract(spark):
    good = dict.fromkeys(S.REQUIRED, "x") | {"schema_version": "1.0.0", "card_token": "a" * 64, "amount": 1.0, "currency": "USD", "channel": "chip", "merchant_country": "US", "mcc": 1, "zip": None, "errors": None, "is_fraud": None}
    bad = good | {"mcc": 10000, "channel": "mail"}
    df = spark.createDataFrame([good, bad], T.StructType([T.StructField(f.name, f.dataType) for f in S.CONTRACT]))
    assert [r[0] for r in df.select(S.reason(df.columns)).collect()] == [None, "channel: is no channel"]
    more = T.StructType([*S.CONTRACT, T.StructField("note", T.StringType())])
    need = T.StructType([*S.CONTRACT, T.StructField("note", T.StringType(), False)])
    assert not S.reads_old_data(S.CONTRACT, more) and S.reads_old_data(S.CONTRACT, need)
    small = T.StructType([T.StructField("n", T.LongType(), False), T.StructField("s", T.StringType())])
    text = """{
  "type": "record",
  "name": "R",
  "namespace": "x",
  "fields": [
    {
      "name": "n",
      "type": "long"
    },
    {
      "name": "s",
      "type": [
        "null",
        "string"
      ],
      "default": null
    }
  ]
}
"""
    assert S.is_current(text, small, "R", "x") and not S.is_current(text, small, "R", "y")


def test_avro_damage(spark):
    schema = T.StructType([T.StructField("n", T.LongType(), False), T.StructField("s", T.StringType()), T.StructField("b", T.BooleanType(), False)])
    df = spark.createDataFrame([(-5, "é", True), (1 << 40, None, False)], schema)
    v = df.select(avro.encode(schema, 3, *map(F.col, schema.names)).alias("v"))
    assert sorted(tuple(r.r)[1:] for r in v.select(avro.decode(schema, F.col("v")).alias("r")).collect()) == [(-5, "é", True), (1 << 40, None, False)]
    other = v.select(avro.decode(schema, F.col("v"), 4).alias("r")).collect()
    assert not any(r.r.ok for r in other)
    lost = spark.createDataFrame([(None, None, None), (1, None, None), (1, None, True)], T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
    both = lost.select(avro.unwritable(schema, *map(F.col, schema.names)), avro.encode(schema, 3, *map(F.col, schema.names)).isNull()).collect()
    assert [tuple(r) for r in both] == [("n: is required", True), ("b: is required", True), (None, False)]
    cut = v.select(F.expr("substring(v, 1, length(v) - 1)").alias("v"))
    assert not [r for r in cut.select(avro.decode(schema, F.col("v")).alias("r")).collect() if r.r.ok]


def test_tables(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    path = f"file://{tmp_path}/t"
    assert tables.read_or_empty(spark, path, schema).count() == 0
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], schema)
    tables.append_new(rows, path, "k")
    tables.append_new(rows.unionByName(spark.createDataFrame([(3, "d")], schema)), path, "k")
    stored = tables.read_or_empty(spark, path, schema)
    assert sorted(r.k for r in stored.collect()) == [1, 2, 3]
    new = tables.upserted(spark.createDataFrame([(1, "a"), (2, "z")], schema), spark.createDataFrame([(2, "y"), (3, "x"), (1, "b")], schema), "k", "v")
    assert sorted(map(tuple, new.collect())) == [(1, "b"), (2, "z"), (3, "x")]
    assert tuple(tables.updated(stored.where("k = 3"), "v", "new", F.col("v") == "d").first()) == (3, "new")
    bad = tables.violations(rows, unique=["k"], required=["v"], accepted={"v": ["a", "b"]}, parents={"k": spark.createDataFrame([(1,)], "id long")})
    assert {r.check: r.violations for r in bad.collect()} == {"v_null": 0, "k_unique": 1, "v_accepted": 1, "orphan_k": 1}
    seen_rows, seen = tables.counted(rows, big=F.col("k") > 1)
    assert seen_rows.count() == 3 and seen.get == {"rows": 3, "big": 1}


def test_tables_are_made_once(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType())])
    spark.sql(f"CREATE DATABASE IF NOT EXISTS made LOCATION 'file://{tmp_path}/made'")
    assert tables.create_missing(spark, {"a": schema, "b": schema}, "made") == ["a", "b"]
    assert tables.create_missing(spark, {"a": schema, "c": schema}, "made") == ["c"]
    assert spark.table("made.a").schema == schema
    spark.sql("DROP DATABASE made CASCADE")


def test_metric_lines(spark):
    lines = ['m{le="0.5",path="/a b"} 3', "plain 4.5", '# HELP m x', "broken", 'm{le="+Inf"} +Inf', "bad x"]
    got = [(r.metric, r.labels, r.value) for r in tables.samples(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [("m", {"le": "0.5", "path": "/a b"}, 3.0), ("plain", {}, 4.5), ("m", {"le": "+Inf"}, float("inf"))]


def test_placeholders(spark):
    row = spark.createDataFrame([("jdbc:${HOST}:${PORT}/${NONE}",)], "t string").select(X.filled(F.col("t"), {"HOST": "db", "PORT": "1$"})).first()
    assert row[0] == "jdbc:db:1$/${NONE}"


def test_psi(spark):
    a = spark.createDataFrame([("x", 90), ("y", 10)], "bin string, ref long")
    b = spark.createDataFrame([("x", 10), ("y", 90)], "bin string, cur long")
    assert abs(M.psi(a, b).first()[0] - 2 * 0.8 * __import__("math").log(9)) < 1e-9
    assert M.psi(a.limit(0), b.limit(0)).first()[0] == 0.0


def test_model_versions(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 7 > 4)) for i in range(70)], "x double, label double")
    m = model.fit(df, ["x"], maxIter=2)
    folder = shared_folder(spark, "models")
    with pytest.raises(FileNotFoundError):
        model.load_current(spark, folder)
    model.save(m, folder, "v1", rows=70)
    loaded, told = model.load_current(spark, folder)
    assert told == {"version": "v1", "rows": 70, "features": ["x"]}
    p = {r.x: r.probability for r in model.scored(loaded, df).collect()}
    assert p[6.0] > 0.5 > p[0.0]
    more = model.scored(loaded, spark.createDataFrame([(None, None)], "x double, other double")).first()
    assert more.other is None and more.x is None and more.probability == p[0.0]
    model._write_json(spark, f"{folder}/current", {"version": "gone"})
    assert model.load_current(spark, folder, "v1")[1]["version"] == "v1"
    assert model.run_id(datetime(2026, 7, 19, 18, 15, 30, tzinfo=timezone.utc), "abc") == "20260719T181530Z-abc"


def test_model_choice(spark):
    rng = random.Random(3)
    rows = [(x := rng.random(), float(x + rng.random() * 0.2 > 0.7), ["train", "train", "validation", "test"][i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "x double, label double, split string")
    m, test, tried = model.choose(df, ["x"], "label", "split", [{"maxIter": 1, "maxDepth": 1}, {"maxIter": 2}])
    assert len(tried) == 1 and test["pr_auc"] > 0.7 and test["tp"] + test["fn"] + test["fp"] + test["tn"] == 100
    want = {(r.label, r.probability >= tried[0]["validation"]["threshold"]) for r in model.scored(m, df.where("split = 'test'")).collect()}
    assert test["tp"] > 0 and (1.0, True) in want


def test_mapping_reasons(spark):
    raw = dict.fromkeys(E.RAW_COLUMNS, "") | {"User": "19", "Card": "4", "Year": "2019", "Month": "2", "Day": "13", "Time": "14:06", "Amount": "$-80.00", "Use Chip": "Swipe Transaction", "MCC": "4829", "Merchant State": "Atlantis", "Errors?": "Bad PIN,"}
    rows = [raw, raw | {"Time": "x"}, raw | {"Amount": "x"}, raw | {"MCC": None}, raw | {"Day": "30"}, dict.fromkeys(E.RAW_COLUMNS)]
    got = E.to_events(spark.createDataFrame(rows, E.RAW_SCHEMA), "s").collect()
    assert [r.reason for r in got] == [None, "Time: is no time", "Amount: is no number", "MCC: is no integer", "Time: is no time", "Time: is no time"]
    first = got[0].asDict()
    assert (first["event_time"], first["amount"], first["channel"], first["merchant_country"], first["errors"], first["is_fraud"], first["zip"]) == ("2019-02-13T14:06:00Z", -80.0, "swipe", "XX", "Bad PIN", None, None)
    again = E.to_events(spark.createDataFrame(rows[:1], E.RAW_SCHEMA), "s").first()
    assert again.event_id == first["event_id"] and len(again.event_id) == 36
    valid = E.to_events(spark.createDataFrame([raw | {"Merchant Name": "x"}], E.RAW_SCHEMA), "s")
    assert valid.select(S.reason(S.CONTRACT.names)).first()[0] is None


def test_one_hots_and_feature_row(spark):
    base = {"k": 1, "amount": 10.0, "merchant_city": "Rome", "mcc": 3000, "errors": ""}
    t0 = datetime(2024, 1, 1)
    rows = [base | {"id": i, "t": t0 + timedelta(hours=i), "channel": ch, "merchant_country": co} for i, (ch, co) in enumerate([("chip", "US"), ("swipe", "XX"), ("online", "IT")])]
    df = spark.createDataFrame(rows, "k int, amount double, merchant_city string, mcc int, errors string, id int, t timestamp_ntz, channel string, merchant_country string")
    got = {r.id: r for r in E.feature_rows(df, "k", "t", "id", ["id"]).collect()}
    assert len(E.FEATURES) == 34 and list(got[0].asDict()) == ["id", *E.FEATURES]
    assert [(got[i].is_cnp, got[i].is_chip, got[i].is_swipe, got[i].is_cross_border, got[i].has_error) for i in range(3)] == [(0, 1, 0, 0, 0), (0, 0, 1, 0, 0), (1, 0, 0, 1, 0)]
    assert (got[0].is_new_city_30d, got[1].is_new_city_30d, got[0].amount_over_mean_30d, got[2].amount_over_mean_30d) == (1, 0, 10.0, 1.0)
    cold = E.online_row(spark.createDataFrame([(1, 5.0)], "id int, amount double")).first()
    assert cold.amount == 5.0 and cold.txn_count_30d == 0.0


def test_next_lsn(spark):
    cases = {b"\x00" * 10: 1, b"\x00\xff": 256, b"\x7f\xff\xff": 1 << 23, (2**64 - 1).to_bytes(10, "big"): 2**64, b"\x09": 10}
    got = [bytes(r[0]) for r in spark.createDataFrame([(k,) for k in cases], "b binary").select(CDC.next_lsn(F.col("b"))).collect()]
    assert got == [v.to_bytes(len(k), "big") for k, v in cases.items()]
    assert spark.createDataFrame([(b"\xff\xff",)], "b binary").select(CDC.next_lsn(F.col("b"))).first()[0] is None


def test_json_is_parsed_once(spark):
    plan = CDC.to_events(spark.createDataFrame([("{}",)], "value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_exact_quantiles_and_places(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([None, 1.5, rng.random()])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r.k, r.share): r.value for r in M.quantiles(df, "v", [0.0, 0.3, 1.0], ["k"]).collect()}
    for k in "ab":
        for share in (0.0, 0.3, 1.0):
            assert abs(got[k, share] - float(np.quantile([v for x, v in rows if x == k and v is not None], share))) < 1e-12
    assert M.quantile_edges(df.limit(0), "v") == []
    scored = spark.createDataFrame([(i, float(i % 50), i % 3 == 0) for i in range(200)], "id int, s double, y boolean")
    best = sorted(((-float(i % 50), i, i % 3 == 0) for i in range(200)))[:20]
    assert tuple(M.precision_at(scored.withColumn("y", F.col("y").cast("int")), "s", [F.asc("id")], "y", 0.1).first()) == (20, sum(b[2] for b in best) / 20)


def test_drift_table(spark):
    a = spark.createDataFrame([(float(i), "x") for i in range(100)], "v double, c string")
    b = spark.createDataFrame([(float(i) * 3, "xy"[i % 2]) for i in range(100)], "v double, c string")
    assert {r.feature: r.verdict for r in M.drift_table(a, b, ["v"], ["c"]).collect()} == {"v": "drifted", "c": "drifted"}
    assert {r.verdict for r in M.drift_table(a, a, ["v"], ["c"]).collect()} == {"stable"}


def test_counters_begin_anew(spark):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t0 + timedelta(seconds=10 * i), v) for i, v in enumerate([5, 9, 2, 2])], "k string, t timestamp_ntz, v long")
    got = [(r.rise, r.rate) for r in M.counter_rates(df, ["k"], "t", "v").orderBy("t").collect()]
    assert got == [(None, None), (4, 0.4), (2, 0.2), (0, 0.0)]


def test_dimensions_order(spark):
    pairs = spark.createDataFrame([(u, c) for u in ("10", "9", "100", "x", "9 ") for c in ("2", "10", "2")], "User string, Card string")
    d = {k: sorted((r.place, r.id, r.parent) for r in v.collect()) for k, v in D.dimensions(pairs, "s").items()}
    assert [i for _, i, _ in d["customer"]] == ["9", "x", "10", "100"] and [p for _, _, p in d["account"]] == ["9", "x", "10", "100"]
    assert [p for _, _, p in d["card"]] == ["acct-9", "acct-9", "acct-x", "acct-x", "acct-10", "acct-10", "acct-100", "acct-100"]


def test_iso_times_of_any_year(spark):
    texts = ["0001-01-01 00:00:00", "0999-12-31 23:59:59.999999", "1969-12-31 23:59:59.9995", "2024-02-29 12:03:04.005", "9999-12-31 23:59:59.999", "+11476-08-15 05:20:00", None]
    t = spark.createDataFrame([(x,) for x in texts], "t string").select(F.col("t").cast("timestamp").alias("t"))
    pairs = [(X.iso(F.col("t"), millis=m), F.date_format("t", f"yyyy-MM-dd'T'HH:mm:ss{s}'Z'")) for m, s in ((True, ".SSS"), (False, ""))]
    for r in t.select(*(c.alias(f"{n}{i}") for i, p in enumerate(pairs) for n, c in zip("ab", p, strict=True))).collect():
        assert r.a0 == r.b0 and r.a1 == r.b1
