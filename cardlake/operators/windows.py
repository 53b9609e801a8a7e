"""Point-in-time features: what had happened before each event, in trailing windows.

A window of w holds the events of the same key that come earlier in (time, sequence) and are at most w old; events of the same
instant that come earlier count, the event itself doesn't.

Keys of up to FRAME events, which is nearly all of them, are summed by range frames: one exchange by key, one sort. A frame costs as many steps
as it holds events, and a key is one task's work, so larger keys go another way with the same results: a window's sum is a running
sum of changes there. An event adds its amount when it comes and takes it away just after it is w old, so the work is linear however
many events a window holds, and a key that has a large share of all events is divided by ranges of time (see ``ordered``).
Distinct values work like that too: an event counts its value unless an earlier event's still lasts, and what the earlier one
takes away at its end is then given back.

Amounts are rounded to hundredths and summed as 64-bit integers, so sums don't depend on the order and hold up to 9e16."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardlake.operators.ordered import bounds, in_ranges, running

WINDOWS = {"1h": 3600, "1d": 86_400, "7d": 604_800, "30d": 2_592_000}
CAP = 2_592_000


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


#: Events of a key beyond which its windows are running sums of changes; with distinct values, whose sets make a frame dearer.
FRAME, FRAME_DISTINCT = 2000, 1000
#: Events of a key beyond which it is divided by ranges of time where each event costs one step.
STREAM = 1_000_000


def by_size(events: DataFrame, key: str, limit: int, large: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Events of keys with up to limit events, and those of the others if there are any.

    Unless large, a table (__large) of the keys with more, is given, this counts all events while the plan is built: a job over the keys."""
    if large is None:
        large = events.groupBy(F.col(key).alias("__large")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("__large")
    if large.isEmpty():
        return events, None
    same = F.col(key).eqNullSafe(F.col("__large"))
    return events.join(large, same, "left_anti"), events.join(large, same, "left_semi")


def trailing(
    events: DataFrame,
    key: str,
    time: str,
    seq: str,
    amount: str,
    error: Column,
    city: str,
    windows: dict[str, int] = WINDOWS,
    *,
    distinct: bool = True,
    frame: int | None = None,
    large: DataFrame | None = None,
) -> DataFrame:
    """events with txn_count, amount_sum, amount_mean, decline_rate (and distinct_city, is_new_city) of each window.

    Events without a time have no history and are none. Null amounts and cities count as events only. Keys of more than frame events (FRAME, or
    FRAME_DISTINCT with distinct values) are those of large (__large), if that is given, else they are counted first (see ``by_size``)."""
    own = events.columns
    cents = F.coalesce((F.col(amount).cast("decimal(18,2)") * 100).cast("long"), F.lit(0))
    rows = events.withColumns({"__us": micros(F.col(time)), "__cents": cents, "__error": F.coalesce(error.cast("long"), F.lit(0))})
    small, large = by_size(rows, key, (FRAME_DISTINCT if distinct else FRAME) if frame is None else frame, large)
    out = _by_frames(small, own, key, seq, city, windows, distinct)
    return out if large is None else out.unionByName(_by_changes(large, own, key, seq, city, windows, distinct))


def _features(name: str, n: Column, cents: Column, errors: Column) -> dict[str, Column]:
    total = cents.cast("double") / 100
    return {
        f"txn_count_{name}": n,
        f"amount_sum_{name}": total,
        f"amount_mean_{name}": F.when(n > 0, total / n).otherwise(0.0),
        f"decline_rate_{name}": F.when(n > 0, errors / n).otherwise(0.0),
    }


def _by_frames(rows: DataFrame, own: list[str], key: str, seq: str, city: str, windows: dict[str, int], distinct: bool) -> DataFrame:
    """A range frame for each window up to the microsecond before the event, and the earlier events of its own instant."""
    c = F.col
    longest = max(windows, key=windows.get)
    zero, none = F.lit(0).cast("long"), F.array().cast(rows.select(F.array(city)).schema[0].dataType)
    timed = c("__us").isNotNull()
    # both kinds of window are dealt by key then. Numbered, as few bytes of many-eventful keys are much work: adaptive execution would give them to few tasks
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), key)
    instant = Window.partitionBy(key, "__us").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    sums = {"n": F.count(F.lit(1)), "s": F.sum("__cents"), "e": F.sum("__error")}
    rows = rows.withColumns(
        {f"__p{x}": F.coalesce(f.over(instant), zero) for x, f in sums.items()} | ({"__pd": F.collect_set(city).over(instant)} if distinct else {})
    )
    found: dict[str, Column] = {}
    for name, w in windows.items():
        before = Window.partitionBy(key).orderBy("__us").rangeBetween(-w * 1_000_000, -1)
        for x, f in sums.items():
            found[f"__{x}_{name}"] = F.coalesce(f.over(before), zero)
        if distinct:
            found[f"__d_{name}"] = F.collect_set(city).over(before)
    rows = rows.withColumns(found)
    more: dict[str, Column] = {}
    for name in windows:
        more |= _features(name, *(F.when(timed, c(f"__{x}_{name}") + c(f"__p{x}")).otherwise(zero) for x in sums))
        if distinct:
            cities = F.when(timed, F.array_union(f"__d_{name}", "__pd")).otherwise(none)
            more[f"distinct_city_{name}"] = F.size(cities).cast("long")
            if name == longest:
                more[f"is_new_city_{name}"] = F.when(c(city).isNotNull(), ~F.array_contains(cities, c(city)))
    return rows.select(*own, *(v.alias(k) for k, v in more.items()))


def _by_changes(rows: DataFrame, own: list[str], key: str, seq: str, city: str, windows: dict[str, int], distinct: bool) -> DataFrame:
    """A running sum of what comes and what becomes too old, over ranges of time."""
    c = F.col
    longest = max(windows, key=windows.get)
    cuts = bounds(rows, "__us")
    if distinct:
        rows = running(in_ranges(rows, "__us", cuts), [key, city], [c("__us"), c(seq)], {"__us": "__was"}, F.max)
        rows = rows.withColumn("__was", F.when(c(city).isNotNull(), c("__was")))
    some = c(city).isNotNull().cast("long") if distinct else F.lit(0).cast("long")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    # a change: when; 0 for a coming event or, after all events of its instant, the number of the window that ends; what it counts
    change = lambda at, ends, counts, cities: F.struct(at.alias("at"), F.lit(ends).alias("ends"), counts.alias("counts"), cities.alias("cities"))
    changes = [change(c("__us"), 0, one, some)]
    for i, w in enumerate(windows.values(), 1):
        changes.append(change(c("__us") + w * 1_000_000, i, -one, -some))
        if distinct:
            last = c("__was") + w * 1_000_000
            changes.append(change(F.when(c("__us") <= last, last), i, zero, one))
    sent = rows.withColumn("__change", F.explode(F.array(*changes))).withColumns({"__at": c("__change.at"), "__ends": c("__change.ends")})
    sent = sent.where((c("__ends") == 0) | (c("__at") <= int(cuts[-1]) if cuts else F.lit(False)))  # ends after the last event change nothing
    steps: dict[str, Column] = {}
    for i, (name, w) in enumerate(windows.items(), 1):
        mine = c("__ends").isin(0, i)
        counts = F.when(mine, c("__change.counts")).otherwise(0)
        steps[f"__n_{name}"], steps[f"__s_{name}"], steps[f"__e_{name}"] = counts, counts * c("__cents"), counts * c("__error")
        if distinct:
            lasts = F.coalesce((c("__ends") == 0) & (c("__us") - c("__was") <= w * 1_000_000), F.lit(False))
            steps[f"__d_{name}"] = F.when(mine, c("__change.cities") - lasts.cast("long")).otherwise(0)
    kept = [*own, "__us", *(["__was"] if distinct else [])]
    event = F.when(c("__ends") == 0, F.struct(*kept)).alias("__event")  # only events need their columns
    sent = sent.withColumns(steps).select(c(key).alias("__k"), "__at", "__ends", c(seq).alias("__seq"), event, *steps)
    out = running(
        in_ranges(sent, "__at", cuts), ["__k"], [c("__at"), c("__ends"), c("__seq")], {s: f"__r{s}" for s in steps}
    ).where("__ends = 0")
    more: dict[str, Column] = {}
    for name in windows:
        more |= _features(name, *(F.coalesce(c(f"__r__{x}_{name}"), zero) for x in "nse"))
        if distinct:
            more[f"distinct_city_{name}"] = F.coalesce(c(f"__r__d_{name}"), zero)
    if distinct:
        known = F.coalesce(c("__event.__us") - c("__event.__was") <= windows[longest] * 1_000_000, F.lit(False))
        more[f"is_new_city_{longest}"] = F.when(c(f"__event.{city}").isNotNull(), ~known)
    return out.select(*(c("__event")[x].alias(x) for x in own), *(v.alias(k) for k, v in more.items()))


def since_last(events: DataFrame, key: str, time: str, seq: str, stream: int = STREAM) -> DataFrame:
    """last_event_ts and time_since_last_txn_s (from 0 to CAP; CAP for a first event). Within a key times ascend, so the greatest earlier one is the last."""
    rows = events.withColumn("__us", micros(F.col(time)))
    small, large = by_size(rows, key, stream)
    order = Window.partitionBy(key).orderBy("__us", seq)
    out = small.withColumn("last_event_ts", F.lag(time).over(order))
    if large is not None:
        out = out.unionByName(
            running(in_ranges(large, "__us"), [key], [F.col("__us"), F.col(seq)], {time: "last_event_ts"}, F.max).drop("__range")
        )
    gap = (F.col("__us") - micros(F.col("last_event_ts"))) / 1e6
    return out.withColumn(
        "time_since_last_txn_s", F.when(gap.isNull(), float(CAP)).otherwise(F.least(F.greatest(gap, F.lit(0.0)), F.lit(float(CAP))))
    ).drop("__us")


def last_marked(events: DataFrame, key: str, time: str, seq: str, mark: Column, stream: int = STREAM) -> DataFrame:
    """Adds last_marked_us: the time, in microseconds, of the key's last earlier event for which mark holds."""
    rows = events.withColumn("__us", micros(F.col(time)))
    rows = rows.withColumn("__marked", F.when(mark, F.col("__us")))
    small, large = by_size(rows, key, stream)
    before = Window.partitionBy(key).orderBy("__us", seq).rowsBetween(Window.unboundedPreceding, -1)
    out = small.withColumn("last_marked_us", F.max("__marked").over(before))
    if large is not None:
        out = out.unionByName(
            running(in_ranges(large, "__us"), [key], [F.col("__us"), F.col(seq)], {"__marked": "last_marked_us"}, F.max).drop("__range")
        )
    return out.drop("__us", "__marked")


def running_totals(events: DataFrame, key: str, time: str, seq: str, amount: str, stream: int = STREAM) -> DataFrame:
    """running_sum and running_count of each key's events so far, the event itself included."""
    rows = events.withColumns(
        {"__us": micros(F.col(time)), "__amount": F.col(amount).cast("decimal(18,2)"), "__one": F.lit(1).cast("long")}
    )
    small, large = by_size(rows, key, stream)
    before = Window.partitionBy(key).orderBy("__us", seq).rowsBetween(Window.unboundedPreceding, -1)
    out = small.withColumns({"__sum": F.sum("__amount").over(before), "__count": F.sum("__one").over(before)})
    if large is not None:
        out = out.unionByName(
            running(in_ranges(large, "__us"), [key], [F.col("__us"), F.col(seq)], {"__amount": "__sum", "__one": "__count"}).drop("__range")
        )
    both = lambda a, b: F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))
    return out.withColumns(
        {"running_sum": both("__sum", "__amount").cast("double"), "running_count": both("__count", "__one").cast("long")}
    ).drop("__us", "__amount", "__one", "__sum", "__count")


def latest_state(events: DataFrame, key: str, time: str, amount: str, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """Each key's state just after its last event, last event included: two aggregations, no windows."""
    last = events.groupBy(key).agg(F.max(time).alias("last_event_ts"))
    rows = events.join(last, key)
    age = micros(F.col("last_event_ts")) - micros(F.col(time))
    aggs = []
    for name, w in windows.items():
        inside = age <= w * 1_000_000
        aggs += [
            F.count_if(inside).alias(f"txn_count_{name}"),
            F.coalesce(F.sum(F.when(inside, F.col(amount).cast("decimal(18,2)"))).cast("double"), F.lit(0.0)).alias(f"amount_sum_{name}"),
        ]
    return rows.groupBy(key, "last_event_ts").agg(*aggs)


def positions(df: DataFrame, time: str, seq: str) -> DataFrame:
    """Adds __pos, the row's place from 1 in the order of (time, seq). seq is a number, by which events of one instant are divided if they are many."""
    rows = in_ranges(df.withColumns({"__us": micros(F.col(time)), "__one": F.lit(1).cast("long")}), "__us", tie=F.col(seq))
    out = running(rows, [], [F.col("__us"), F.col(seq)], {"__one": "__before"})
    return out.withColumn("__pos", F.coalesce("__before", F.lit(0)) + 1).drop("__us", "__one", "__before", "__range")
