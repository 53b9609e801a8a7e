"""Drift and ranking metrics as aggregations."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardlake.operators.ordered import in_ranges, running

EPSILON = 1e-4


def quantiles(df: DataFrame, column: str, shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """keys, share and value: exact quantiles, linear between neighbours. No task holds a column, or a key's values: distinct values are
    counted, and a value is at a place if the counts by ranges before it say so."""
    keys = keys or []
    at = F.col(column).cast("double")
    points = df.where(at.isNotNull()).groupBy(*keys, at.alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(in_ranges(points, "__at"), keys, [F.asc("__at")], {"__n": "__before"})
    ranked = ranked.withColumn("__before", F.coalesce("__before", F.lit(0)))
    sizes = points.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    whole = ranked.join(sizes, keys) if keys else ranked.join(F.broadcast(sizes))  # one row without keys
    whole = whole.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("__place", F.col("share") * (F.col("__all") - 1))
    holds = lambda place: (F.col("__before") <= place) & (place < F.col("__before") + F.col("__n"))
    lo, hi = F.floor("__place"), F.ceil("__place")
    near = whole.where(holds(lo) | holds(hi)).groupBy(*keys, "share", "__place").agg(
        F.max(F.when(holds(lo), F.col("__at"))).alias("lo"), F.max(F.when(holds(hi), F.col("__at"))).alias("hi")
    )
    return near.select(*keys, "share", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("__place") - F.floor("__place"))).alias("value"))


#: Shares on either side of a quantile that bracket it: more than percentile_approx, asked for 1 in 10,000, is off.
SLACK = 2.5e-4
#: Distinct values inside brackets that may come to the driver.
LOCAL = 100_000


def _counted_up(rows: list) -> Iterator[tuple[int, float, int, int]]:
    """Of rows (of, zone, v, n) in order: of, v, the rows before it, n."""
    at, was = 0, None
    for r in rows:
        at = at if r["of"] == was else 0
        yield r["of"], r["v"], at, r["n"]
        at, was = at + r["n"], r["of"]


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float]]:
    """Exact quantiles of many columns, linear between neighbours, in two passes; empty for columns without values.

    Sketches of the first pass bracket each quantile. The second counts, for all columns at once, the rows between brackets as one and the values
    inside them one by one, so that places are exact. A task gets the distinct values of one bracket, a two-thousandth of a column. Should a
    bracket miss its quantile, which the counts show, that column goes by ``quantiles``. Up to LOCAL values inside brackets are counted up in the driver."""
    c = F.col
    number = {x: F.nanvl(c(f"`{x}`").cast("double"), F.lit(None)) for x in columns}
    around = [min(max(s + d, 0.0), 1.0) for s in shares for d in (-SLACK, SLACK)]
    aggs = [(F.percentile_approx(v, around, 10_000), F.count(v), F.min(v), F.max(v)) for v in number.values()]
    told = df.agg(*(x.alias(f"{k}_{i}") for i, four in enumerate(aggs) for k, x in zip("qnlh", four, strict=True))).first()
    brackets: list[list[list[float]]] = []
    ranks: list[list[int]] = []
    for i in range(len(columns)):
        q, n = told[f"q_{i}"] or [], told[f"n_{i}"]
        mine: list[list[float]] = []
        for k, s in enumerate(shares if n else []):
            lo = told[f"l_{i}"] if s <= SLACK else q[2 * k]
            hi = told[f"h_{i}"] if s >= 1 - SLACK else q[2 * k + 1]
            if mine and lo <= mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], hi)
            else:
                mine.append([lo, hi])
        brackets.append(mine)
        ranks.append(sorted({r for s in shares for r in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))}) if n else [])
    doubles = lambda xs: F.array(*map(F.lit, xs)).cast("array<double>")

    def zone(v: Column, mine: list[list[float]]) -> Column:
        """Odd inside a bracket, even between two."""
        return F.size(F.filter(doubles([x for x, _ in mine]), lambda x: x <= v)) + F.size(F.filter(doubles([x for _, x in mine]), lambda x: x < v))

    some = [i for i in range(len(columns)) if ranks[i]]
    found: dict[int, dict[int, float]] = {i: {} for i in some}
    if some:
        values = [F.struct(F.lit(i).alias("of"), v.alias("v"), zone(v, brackets[i]).alias("zone")) for i in some for v in [number[columns[i]]]]
        points = df.select(F.explode(F.array(*values)).alias("x")).where(c("x.v").isNotNull()).groupBy(
            c("x.of").alias("of"), c("x.zone").alias("zone"), F.when(c("x.zone") % 2 == 1, c("x.v")).alias("v")
        ).agg(F.count(F.lit(1)).alias("n"))
        if sum(told[f"n_{i}"] for i in some) * 4 * SLACK * len(shares) <= LOCAL:  # so many values are inside brackets at most, unless they repeat
            rows = points.limit(2 * LOCAL + 1).collect()
            if len(rows) <= 2 * LOCAL:
                for of, v, before, n in _counted_up(sorted(rows, key=lambda r: (r["of"], r["zone"], r["v"] or 0.0))):
                    found[of] |= {k: v for k in ranks[of] if v is not None and before <= k < before + n}
                some = []
    if some:
        earlier = Window.partitionBy("of").orderBy("zone").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bracket
        zones = points.groupBy("of", "zone").agg(F.sum("n").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(earlier), F.lit(0)))
        inside = Window.partitionBy("of", "zone").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        placed = points.where(c("zone") % 2 == 1).withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        placed = placed.join(F.broadcast(zones.drop("all")), ["of", "zone"]).withColumn("at", c("base") + c("before"))  # a row for each bracket
        wanted = F.get(F.array(*(F.array(*map(F.lit, r)).cast("array<long>") for r in ranks)), c("of"))
        hit = F.filter(wanted, lambda r: (r >= c("at")) & (r < c("at") + c("n")))
        for r in placed.select("of", "v", hit.alias("hit")).where(F.size("hit") > 0).collect():  # two rows for each quantile at most
            found[r.of] |= dict.fromkeys(r.hit, r.v)
    out: dict[str, list[float]] = {}
    for i, name in enumerate(columns):
        n = told[f"n_{i}"]
        if ranks[i] and len(found[i]) < len(ranks[i]):
            by = {r.share: r.value for r in quantiles(df, name, shares).collect()}
            out[name] = [by[s] for s in shares]
            continue
        places = [s * (n - 1) for s in shares] if n else []
        out[name] = [(lo := found[i][math.floor(p)]) + (found[i][math.ceil(p)] - lo) * (p - math.floor(p)) for p in places]
    return out


def quantile_edges(df: DataFrame, column: str, bins: int = 10) -> list[float]:
    """Ascending exact quantiles without repeats (bins + 1 at most); none for an empty column."""
    return sorted(set(exact_quantiles(df, [column], [i / bins for i in range(bins + 1)])[column]))


def _bin(value: Column, edges: list[float]) -> Column:
    edges = edges or [0.0, 1.0]
    if len(edges) == 1:
        edges = [edges[0] - 0.5, edges[0] + 0.5]
    inner = F.array(*(F.lit(float(e)) for e in edges[1:-1])).cast("array<double>")
    return F.when(value.isNotNull(), F.size(F.filter(inner, lambda e: e <= value)).cast("string"))


def numeric_bins(df: DataFrame, column: str, edges: list[float], as_: str) -> DataFrame:
    """(bin, as_): rows in each [e_i, e_i+1); those outside go to the end bins."""
    return df.where(F.col(column).isNotNull()).groupBy(_bin(F.col(column), edges).alias("bin")).agg(F.count(F.lit(1)).alias(as_))


def categories(df: DataFrame, column: str, as_: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("bin")).agg(F.count(F.lit(1)).alias(as_))


def psi(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Population stability index of (bin, ref) and (bin, cur), shares not below EPSILON; 0 if both are empty."""
    both = reference.join(current, "bin", "full").select(F.coalesce("ref", F.lit(0)).alias("ref"), F.coalesce("cur", F.lit(0)).alias("cur"))
    total = both.agg(F.sum("ref").alias("r"), F.sum("cur").alias("c"))  # one row
    r, c = (F.greatest(F.coalesce(F.try_divide(F.col(x), F.col(n)), F.lit(0.0)), F.lit(EPSILON)) for x, n in (("ref", "r"), ("cur", "c")))
    return both.join(F.broadcast(total)).agg(F.coalesce(F.sum((c - r) * F.log(c / r)), F.lit(0.0)).alias("psi"))


def confusion(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    p, y = F.col(score) >= threshold, F.col(label) == 1
    n = df.agg(
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn")
    )
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n = n.withColumns({"precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn"))})
    return n.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """A row for each distinct score: tp and n there, ctp and cn at or above it, all and pos of all. Scores are grouped first; those are summed up by ranges."""
    points = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("bigint")).alias("tp"), F.count(F.lit(1)).alias("n"))
    total = points.agg(F.sum("tp").alias("pos"), F.sum("n").alias("all"))  # one row
    up = running(in_ranges(points, "score"), [], [F.desc("score")], {"tp": "btp", "n": "bn"}, downward=True)
    so_far = lambda before, own: (F.coalesce(F.col(before), F.lit(0)) + F.col(own)).alias(f"c{own}")
    return up.join(F.broadcast(total)).select("score", "tp", "n", so_far("btp", "tp"), so_far("bn", "n"), "pos", "all")


def average_precision(points: DataFrame) -> DataFrame:
    return points.agg(F.sum(F.col("tp") / F.col("pos") * F.col("ctp") / F.col("cn")).alias("average_precision"))


def roc_auc(points: DataFrame) -> DataFrame:
    """Null with one class only."""
    c = F.col
    return points.agg(
        F.try_divide(
            F.sum((c("n") - c("tp")) * ((c("ctp") - c("tp")) + c("tp") / 2)), F.max(c("pos") * (c("all") - c("pos")))
        ).alias("roc_auc")
    )


def best_threshold(points: DataFrame) -> DataFrame:
    """The score of greatest F1, the highest on ties."""
    f1 = F.try_divide(2.0 * F.col("ctp"), F.col("cn") + F.col("pos"))
    return points.select(F.col("score").alias("threshold"), f1.alias("f1")).orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def precision_at(df: DataFrame, score: str, ties: list[Column], label: str, share: float, tie: str | None = None) -> DataFrame:
    """Precision among the k = max(1, round(n * share)) of highest score. Places come from counts by ranges, so k may be large. tie names a number
    that is first among ties, ascending: with it the number of equal scores may be large, too."""
    k = max(1, round(df.count() * share))
    ranked = running(
        in_ranges(df.withColumn("__one", F.lit(1).cast("long")), score, tie=F.col(tie) if tie else None, tie_descends=True),
        [],
        [F.desc(score), *ties],
        {"__one": "__before"},
        downward=True,
    )
    first = ranked.where(F.coalesce("__before", F.lit(0)) < k)
    return first.agg(F.count(F.lit(1)).alias("k"), F.avg(F.col(label).cast("double")).alias("precision"))


def histogram_quantile(buckets: DataFrame, q: float) -> DataFrame:
    """From cumulative (le, cnt), le ascending with infinity last: linear within a bucket, the last finite bound beyond."""
    by = Window.orderBy("le")  # a row for each bucket
    b = buckets.select(
        "le",
        "cnt",
        F.coalesce(F.lag("le").over(by), F.lit(0.0)).alias("lo"),
        F.coalesce(F.lag("cnt").over(by), F.lit(0)).alias("before"),
        F.max("cnt").over(Window.orderBy("le").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"),
    )
    inside = b.where(F.col("cnt") >= q * F.col("all")).orderBy("le").limit(1)
    value = F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(
        F.col("lo") + (F.col("le") - F.col("lo")) * F.coalesce(
            F.try_divide(q * F.col("all") - F.col("before"), F.col("cnt") - F.col("before")), F.lit(0.0)
        )
    )
    return inside.select(F.lit(q).alias("q"), value.alias("value"))


def counter_rates(samples: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """samples with rise (since the sample before; from 0 where a counter began anew) and rate (a second); null for a first one."""
    was = F.lag(value).over(Window.partitionBy(*keys).orderBy(time))
    then = F.lag(time).over(Window.partitionBy(*keys).orderBy(time))
    rise = F.when(was.isNotNull(), F.when(F.col(value) < was, F.col(value)).otherwise(F.col(value) - was))
    seconds = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 1e6
    return samples.withColumns({"rise": rise, "rate": rise / seconds})


def drift_table(reference: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str], warn: float = 0.1, alarm: float = 0.2) -> DataFrame:
    """feature, psi and verdict (stable, moderate, drifted) of each column: two passes over the reference for all numeric columns' edges, one over both tables for all bins."""
    if twice := set(numeric) & set(categorical):
        raise ValueError(f"numeric and categorical: {', '.join(sorted(twice))}")
    edges = exact_quantiles(reference, numeric, [i / 10 for i in range(11)]) if numeric else {}
    value = lambda x: F.nanvl(F.col(f"`{x}`").cast("double"), F.lit(None))
    bins = [(x, _bin(value(x), sorted(set(edges[x])))) for x in numeric] + [(x, F.col(f"`{x}`").cast("string")) for x in categorical]
    cells = F.explode(F.array(*(F.struct(F.lit(x).alias("feature"), b.alias("bin")) for x, b in bins))).alias("x")
    both = reference.select(cells, F.lit(True).alias("old")).unionByName(current.select(cells, F.lit(False).alias("old")))
    counts = both.where("x.bin IS NOT NULL").groupBy("x.feature", "x.bin").agg(F.count_if("old").alias("ref"), F.count_if(~F.col("old")).alias("cur"))
    total = counts.groupBy("feature").agg(F.sum("ref").alias("r"), F.sum("cur").alias("c"))  # a row for each feature
    r, c = (F.greatest(F.coalesce(F.try_divide(F.col(x), F.col(n)), F.lit(0.0)), F.lit(EPSILON)) for x, n in (("ref", "r"), ("cur", "c")))
    found = counts.join(F.broadcast(total), "feature").groupBy("feature").agg(F.sum((c - r) * F.log(c / r)).alias("psi"))
    names = reference.sparkSession.createDataFrame([(x,) for x, _ in bins], "feature string")
    out = names.join(F.broadcast(found), "feature", "left").withColumn("psi", F.coalesce("psi", F.lit(0.0)))
    return out.withColumn("verdict", F.when(F.col("psi") > alarm, "drifted").when(F.col("psi") >= warn, "moderate").otherwise("stable"))
