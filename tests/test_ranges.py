"""Ranges in which many rows tie: none holds much more than its share, and places are what they are without ranges."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cardlake.operators import dimensions as D
from cardlake.operators import metrics as M
from cardlake.operators import windows as W
from cardlake.operators.ordered import RANGE, in_ranges

T0 = datetime(2024, 1, 1)
N = 20_000


@pytest.fixture(scope="module")
def scores(spark):
    """99 % of the scores are 0, some are null."""
    rng = random.Random(1)
    ids = list(range(N))
    rng.shuffle(ids)
    rows = [(i, 0.0 if k < 0.99 * N else None if k % 5 == 0 else rng.choice([0.5, 0.25, rng.random()]), k % 3 == 0) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "id long, score double, label boolean").repartition(5).cache()


@pytest.mark.parametrize("down", [False, True])
def test_equal_values_are_divided_by_ties(spark, scores, down):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = in_ranges(scores, "score", tie=F.col("id"), tie_descends=down).select("id", "score", RANGE).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sizes = Counter(r[RANGE] for r in got)
    assert len(got) == N and max(sizes.values()) <= 2 * N / 16
    order = sorted(got, key=lambda r: (float("-inf") if r.score is None else r.score, -r.id if down else r.id))
    assert [r[RANGE] for r in order] == sorted(r[RANGE] for r in got)


def test_precision_among_equal_scores(scores):
    rows = [(r.score, r.id, r.label) for r in scores.where("score IS NOT NULL").collect()]
    for share in (0.001, 0.02, 0.5):
        k = max(1, round(len(rows) * share))
        best = sorted(rows, key=lambda r: (-r[0], r[1]))[:k]
        got = M.precision_at(scores.where("score IS NOT NULL"), "score", [F.asc("id")], "label", share, tie="id").first()
        assert got.k == k and got.precision == pytest.approx(sum(r[2] for r in best) / k)


def test_places_of_one_instant(spark):
    rng = random.Random(2)
    rows = [(i, T0 if rng.random() < 0.9 else T0 + timedelta(seconds=rng.randrange(-50, 50))) for i in range(5000)]
    rng.shuffle(rows)
    e = spark.createDataFrame(rows, "id long, ts timestamp").repartition(3)
    got = {r.id: r["__pos"] for r in W.positions(e, "ts", "id").collect()}
    want = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    assert got == want
    assert W.positions(e.limit(0), "ts", "id").count() == 0


def test_places_of_names_that_begin_alike(spark):
    """All of one length and with the same first two bytes."""
    names = [f"user{i:04d}" for i in range(3000)] + ["u", "éé", "größe", "user", "zz"]
    random.Random(3).shuffle(names)
    df = spark.createDataFrame([(x,) for x in names], "User string").repartition(3)
    got = {r.User: r.place for r in D.placed(df, ["User"]).collect()}
    assert got == {x: k for k, x in enumerate(sorted(names, key=lambda x: (len(x), x.encode())), 1)}


def test_numbered_windows_are_not_put_together(spark):
    """Few bytes of many-eventful keys are dealt to all tasks."""
    e = spark.range(4000).select(F.col("id").alias("event_id"), (F.col("id") % 40).alias("user_id"), F.timestamp_seconds("id").alias("ts"), F.lit(1.0).alias("value"), F.lit("c").alias("city"))
    plan = W.trailing(e, "user_id", "ts", "event_id", "value", F.lit(False), "city", large=spark.createDataFrame([], "__large long"))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_known_large_keys_are_not_counted(spark):
    rows = [(i, i % 3, T0 + timedelta(minutes=i), float(i % 7), f"c{i % 4}") for i in range(120)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double, city string")
    plain = W.trailing(e, "user_id", "ts", "event_id", "value", F.lit(False), "city")
    some = W.trailing(e, "user_id", "ts", "event_id", "value", F.lit(False), "city", large=spark.createDataFrame([(1,)], "__large long"))
    assert sorted(map(str, plain.collect())) == sorted(map(str, some.collect()))
