"""Running aggregates over ordered rows, without a task that holds a whole key (or, with no key, the whole table).

Rows are cut into ranges of the order's first value with about as many rows each. A range's totals for a key are small; carried
on as a leading row of the later ranges, they make each (key, range) a task's work of its own."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "__range"


def bounds(rows: DataFrame, value: str) -> list[float]:
    """Ascending quantiles of a number, one for each shuffle partition; the last is the greatest value. Empty for an empty table."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    at = F.col(value).cast("double")
    found = rows.agg(F.percentile_approx(at, [i / n for i in range(1, n + 1)], 10_000).alias("q"), F.max(at).alias("top")).first()
    return sorted({*found["q"][:-1], found["top"]}) if found["q"] else []


def _bucket(rows: DataFrame, splits: list[float], name: str) -> DataFrame:
    """name: which of the ascending splits a row's __value has reached, by binary search."""
    if not splits:
        return rows.withColumn(name, F.lit(0))
    cut = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="__value", outputCol="__bucket")
    return cut.transform(rows).withColumn(name, F.col("__bucket").cast("int")).drop("__bucket")


def in_ranges(rows: DataFrame, value: str, cuts: list[float] | None = None, *, tie: Column | None = None, tie_descends: bool = False) -> DataFrame:
    """Adds RANGE, ascending with the number in value; nulls are in the first one. cuts are bounds, here those of rows.

    Equal values share a range, unless tie is given, a number that orders them: a value that fills more than a range is then divided by its
    ties, ascending or, if tie_descends, descending with RANGE. Which values do that, and where their ties are cut, takes two more passes over
    the values, and a table that grows with the number of ranges only is sent to tasks."""
    rows = rows.withColumn("__value", F.coalesce(F.col(value).cast("double"), F.lit(float("-inf"))))
    if tie is None:
        return _bucket(rows, (bounds(rows, value) if cuts is None else cuts)[:-1], RANGE).drop("__value")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    found = rows.agg(F.percentile_approx("__value", [i / n for i in range(1, n + 1)], 10_000)).first()[0] or []
    often = {v: k for v, k in Counter(found).items() if k > 1}
    alone = {x for v in often for x in (v, math.nextafter(v, math.inf))}  # a frequent value has a bucket of its own
    splits = sorted({*found[:-1], *alone} - {float("-inf"), float("inf")})
    if not often:
        return _bucket(rows, splits, RANGE).drop("__value")
    table: list[tuple[float, list[list[float]]]] = []
    rows = rows.withColumn("__tie", tie.cast("double"))
    for size in sorted({1 << (k - 1).bit_length() for k in often.values()}):  # values of about as many ranges at a time
        mine = [v for v, k in often.items() if 1 << (k - 1).bit_length() == size]
        ties = F.percentile_approx("__tie", [i / size for i in range(1, size)], 10_000).alias("ties")
        for r in rows.where(F.col("__value").isin(mine)).groupBy("__value").agg(ties).collect():  # size numbers of n / size values
            at = sorted(set(r.ties or []))
            wide = max(1, math.isqrt(len(at)))
            table.append((r["__value"], [at[i : i + wide] for i in range(0, len(at), wide)]))
    known = rows.sparkSession.createDataFrame(table, "__of double, __cuts array<array<double>>")
    rows = _bucket(rows, splits, "__whole").join(F.broadcast(known), F.col("__value") == F.col("__of"), "left")  # at most 2 n log n numbers
    passed = lambda x: F.size(F.filter(x, lambda y: y <= F.coalesce("__tie", F.lit(float("-inf")))))
    block = passed(F.transform("__cuts", lambda x: x[0]))
    inside = F.when(block > 0, (block - 1) * F.size(F.col("__cuts")[0]) + passed(F.get("__cuts", block - 1))).otherwise(0)
    sub = F.coalesce(F.when(F.size("__cuts") > 0, inside), F.lit(0))
    step = 2 * n + 2
    rows = rows.withColumn(RANGE, F.col("__whole") * step + (step - 1 - sub if tie_descends else sub))
    return rows.drop("__value", "__tie", "__of", "__cuts", "__whole")


def running(rows: DataFrame, key: list[str], order: list[Column], values: dict[str, str], how: Callable[[Column], Column] = F.sum, *, downward: bool = False) -> DataFrame:
    """rows (with RANGE) and for each (value, name) of values the value's aggregate over the key's earlier rows, null for a first one.

    order is total within a key and ascends with RANGE, or descends if downward. how is associative: sum, max or min."""
    part = [*key, RANGE]
    totals = rows.groupBy(*part).agg(*(how(F.col(v)).alias(v) for v in values))
    by = F.desc(RANGE) if downward else F.asc(RANGE)
    before = Window.partitionBy(*key).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    carried = totals.select(*part, *(how(F.col(v)).over(before).alias(v) for v in values), F.lit(0).alias("__own"))
    every = rows.withColumn("__own", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    inside = Window.partitionBy(*part).orderBy("__own", *order).rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumns({name: how(F.col(v)).over(inside) for v, name in values.items()}).where("__own = 1").drop("__own")
