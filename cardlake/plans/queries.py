"""The library's queries over the driver's tables, each next to SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardlake.functions import cdc as CDC
from cardlake.functions import events as E
from cardlake.functions import expr as X
from cardlake.functions import schema as S
from cardlake.operators import dimensions as D
from cardlake.operators import metrics as M
from cardlake.operators import windows as W
from cardlake.session import shared_folder
from cardlake.sources import avro, changes, keyed, tables
from cardlake.streaming import alerts, jobs, metrics, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dec(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


# ---- point-in-time windows

_K = "WITH o AS (SELECT *, epoch_us({t}) AS us FROM {f}), e AS (SELECT *, us * 4096 + row_number() OVER (PARTITION BY {k}, us ORDER BY {s}) AS ok FROM o)"


def _pit(table: str, key: str, time: str, seq: str, amount: str, error: str, city: str, keep: str, which: list[str]) -> str:
    cols, frames = [], []
    for name, w in W.WINDOWS.items():
        frames.append(f"w{name} AS (PARTITION BY {key} ORDER BY ok RANGE BETWEEN {w * 1_000_000 * 4096 + 2048} PRECEDING AND 1 PRECEDING)")
        o = f"OVER w{name}"
        total = f"CAST(coalesce(sum({dec(amount)}) {o}, 0) AS DOUBLE)"
        every = {
            "count": f"count(*) {o} AS txn_count_{name}",
            "sum": f"{total} AS amount_sum_{name}",
            "mean": f"CASE WHEN count(*) {o} > 0 THEN {total} / count(*) {o} ELSE 0.0 END AS amount_mean_{name}",
            "rate": f"CASE WHEN count(*) {o} > 0 THEN CAST(count(*) FILTER (WHERE {error}) {o} AS DOUBLE) / count(*) {o} ELSE 0.0 END AS decline_rate_{name}",
            "distinct": f"CAST(count(DISTINCT {city}) {o} AS BIGINT) AS distinct_city_{name}",
        }
        cols += [every[x] for x in which]
    if "distinct" in which:
        cols.append(f"NOT coalesce(list_contains(list({city}) OVER w30d, {city}), false) AS is_new_city_30d")
    return f"{_K.format(t=time, f=table, k=key, s=seq)} SELECT {keep}, {', '.join(cols)} FROM e WINDOW {', '.join(frames)}"


def _trailing_events(spark, sf, distinct):
    e = t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return W.trailing(e, "user_id", "ts", "event_id", "value", c("event_type") == "error", "event_type", distinct=distinct)


_EV = ("events", "user_id", "ts", "event_id", "value", "event_type = 'error'", "event_type", "event_id")


@query(_pit(*_EV, ["count", "sum", "mean", "rate"]))
def pit_window_counts(spark, sf):
    out = _trailing_events(spark, sf, False)
    return out.drop("user_id", "ts", "event_type", "value")


@query(_pit(*_EV, ["distinct"]))
def pit_window_distinct(spark, sf):
    return _trailing_events(spark, sf, True).select("event_id", *(f"distinct_city_{w}" for w in W.WINDOWS), "is_new_city_30d")


@query(_pit("orders", "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus = 'F'", "o_orderpriority", "o_orderkey", ["count", "sum", "rate", "distinct"]))
def pit_window_ties(spark, sf):
    o = t(spark, sf, "orders")
    out = W.trailing(o, "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", c("o_orderstatus") == "F", "o_orderpriority")
    return out.select(
        "o_orderkey",
        *(f"{m}_{w}" for w in W.WINDOWS for m in ("txn_count", "amount_sum", "decline_rate", "distinct_city")),
        "is_new_city_30d",
    )


@query(f"""SELECT event_id, lag(ts) OVER w AS last_event_ts, CASE WHEN lag(ts) OVER w IS NULL THEN {W.CAP}.0::DOUBLE ELSE least(greatest((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6::DOUBLE,
0.0::DOUBLE), {W.CAP}.0::DOUBLE) END AS time_since_last_txn_s
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def time_since_last(spark, sf):
    return W.since_last(t(spark, sf, "events"), "user_id", "ts", "event_id").select("event_id", "last_event_ts", "time_since_last_txn_s")


@query(f"""{_K.format(t='ts', f='events', k='user_id', s='event_id')}, m AS (SELECT event_id, value, count(*) OVER w AS n, coalesce(CAST(sum({dec('value')}) OVER w AS DOUBLE),
0) AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ok RANGE BETWEEN {2_592_000 * 1_000_000 * 4096 + 2048} PRECEDING AND 1 PRECEDING)) SELECT event_id,
round(value / CASE WHEN n = 0 OR s = 0 THEN 1.0 ELSE s / n END, 6) AS amount_over_mean_30d
FROM m""")
def amount_over_mean(spark, sf):
    e = W.trailing(
        t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value"),
        "user_id",
        "ts",
        "event_id",
        "value",
        F.lit(False),
        "event_type",
        {"30d": 2_592_000},
        distinct=False,
    )
    mean = c("amount_mean_30d")
    return e.select("event_id", F.round(c("value") / F.when(mean == 0, 1.0).otherwise(mean), 6).alias("amount_over_mean_30d"))


@query("WITH l AS (SELECT user_id, max(ts) AS last_event_ts FROM events GROUP BY 1) SELECT user_id, last_event_ts, " + ", ".join(f"count(*) FILTER (WHERE epoch_us(last_event_ts) - epoch_us(ts) <= {w * 1_000_000}) AS txn_count_{n}, coalesce(CAST(sum({dec('value')}) FILTER (WHERE epoch_us(last_event_ts) - epoch_us(ts) <= {w * 1_000_000}) AS DOUBLE), 0.0) AS amount_sum_{n}" for n, w in W.WINDOWS.items()) + " FROM events JOIN l USING (user_id) GROUP BY 1, 2")
def latest_card_state(spark, sf):
    return W.latest_state(t(spark, sf, "events"), "user_id", "ts", "value")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row_id FROM events")
def stable_row_id(spark, sf):
    return W.positions(t(spark, sf, "events"), "ts", "event_id").select("event_id", c("__pos").cast("bigint").alias("row_id"))


@query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5""")
def tail_n_per_key(spark, sf):
    return tables.first_rows(t(spark, sf, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("event_id", "user_id")


@query("""WITH p AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS pos, count(*) OVER () AS n
FROM events),
s AS (SELECT *, CASE WHEN pos <= floor(floor(n * 0.8) * 0.8) THEN 'train' WHEN pos <= floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split
FROM p) SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE event_type = 'error') AS n_pos, min(ts) AS first_ts,
max(ts) AS last_ts, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN count(*) FILTER (WHERE event_type <> 'error') / CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) ELSE 1.0 END AS scale_pos_weight
FROM s GROUP BY 1""")
def time_split_counts(spark, sf):
    e = t(spark, sf, "events")
    pos, n = W.positions(e, "ts", "event_id"), e.count()
    split = F.when(c("__pos") <= int(int(n * 0.8) * 0.8), "train").when(c("__pos") <= int(n * 0.8), "validation").otherwise("test")
    err = c("event_type") == "error"
    return pos.groupBy(split.alias("split")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(err).alias("n_pos"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.coalesce(F.try_divide(F.count_if(~err).cast("double"), F.count_if(err)), F.lit(1.0)).alias("scale_pos_weight"),
    )


@query(f"""SELECT event_id, CAST(sum({dec('value')}) OVER w AS DOUBLE) AS running_sum, count(*) OVER w AS running_count
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def prefix_sums(spark, sf):
    return W.running_totals(t(spark, sf, "events"), "user_id", "ts", "event_id", "value").select("event_id", "running_sum", "running_count")


# ---- mapping, validation, enrichment

_RAW = f"""SELECT event_id AS row, CAST(user_id AS VARCHAR) AS "User", CAST(event_id % 3 AS VARCHAR) AS "Card",
CAST(year(ts) AS VARCHAR) AS "Year", CAST(month(ts) AS VARCHAR) AS "Month",
CASE WHEN event_id % 17 = 3 THEN '31' ELSE CAST(day(ts) AS VARCHAR) END AS "Day",
CASE WHEN event_id % 19 = 4 THEN '25:99' ELSE strftime(ts, '%H:%M') END AS "Time",
CASE WHEN event_id % 23 = 5 THEN 'abc' ELSE '$' || CAST({dec("value")} AS VARCHAR) END AS "Amount",
CASE event_type WHEN 'click' THEN 'Chip Transaction' WHEN 'view' THEN 'Swipe Transaction' ELSE 'Online Transaction' END AS "Use Chip",
CAST(-event_id * 7 AS VARCHAR) AS "Merchant Name", ' City ' || (event_id % 9) AS "Merchant City",
CASE event_id % 5 WHEN 0 THEN 'AZ' WHEN 1 THEN 'Italy' WHEN 2 THEN 'Atlantis' WHEN 3 THEN '' ELSE ' ca' END AS "Merchant State",
CASE event_id % 4 WHEN 0 THEN '85719.0' WHEN 1 THEN '' WHEN 2 THEN 'nan' ELSE 'K1A' END AS "Zip",
CASE WHEN event_id % 29 = 6 THEN '' ELSE CAST(2950 + event_id % 100 AS VARCHAR) END AS "MCC",
CASE event_type WHEN 'error' THEN 'Bad PIN,' ELSE '' END AS "Errors?",
CASE event_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE '' END AS "Is Fraud?" FROM events"""


def raw_rows(spark, sf) -> DataFrame:
    """events as rows of a raw file: all text, some of it broken."""
    e, k = t(spark, sf, "events"), c("event_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    return e.select(
        k.alias("row"),
        c("user_id").cast("string").alias("User"),
        (k % 3).cast("string").alias("Card"),
        F.year("ts").cast("string").alias("Year"),
        F.month("ts").cast("string").alias("Month"),
        F.when(k % 17 == 3, "31").otherwise(F.dayofmonth("ts").cast("string")).alias("Day"),
        F.when(k % 19 == 4, "25:99").otherwise(F.date_format("ts", "HH:mm")).alias("Time"),
        F.when(k % 23 == 5, "abc").otherwise(F.concat(F.lit("$"), c("value").cast("decimal(18,2)").cast("string"))).alias("Amount"),
        F.when(c("event_type") == "click", "Chip Transaction").when(c("event_type") == "view", "Swipe Transaction").otherwise("Online Transaction").alias("Use Chip"),
        (-k * 7).cast("string").alias("Merchant Name"),
        F.concat(F.lit(" City "), k % 9).alias("Merchant City"),
        pick(["AZ", "Italy", "Atlantis", "", " ca"]).alias("Merchant State"),
        pick(["85719.0", "", "nan", "K1A"]).alias("Zip"),
        F.when(k % 29 == 6, "").otherwise((2950 + k % 100).cast("string")).alias("MCC"),
        F.when(c("event_type") == "error", "Bad PIN,").otherwise("").alias("Errors?"),
        pick(["Yes", "No", ""]).alias("Is Fraud?"),
    )


_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.COUNTRIES.items())
_STATES = ", ".join(f"'{x}'" for x in X.US_STATES)
_DIGEST = "md5(concat_ws(chr(31), " + ", ".join(f'"{n}"' for n in E.RAW_COLUMNS) + "))"
_UUID = " || '-' || ".join(f"substr({_DIGEST}, {i}, {n})" for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
_MAPPED = f"""WITH raw AS ({_RAW}),
p AS (SELECT *, CASE "Use Chip" WHEN 'Chip Transaction' THEN 'chip' WHEN 'Swipe Transaction' THEN 'swipe' ELSE 'online' END AS channel, trim("Merchant State") AS st, {_UUID} AS id,
TRY_CAST("Year" || '-' || "Month" || '-' || "Day" || ' ' || "Time" || ':00' AS TIMESTAMP) AS tm, TRY_CAST(replace("Amount", '$', '') AS DOUBLE) AS amt, TRY_CAST("MCC" AS INT) AS code FROM raw),
mapped AS (SELECT row, '1.0.0' AS schema_version, id AS event_id, strftime(tm, '%Y-%m-%dT%H:%M:%SZ') AS event_time, sha256('salt:' || "User" || ':' || "Card") AS card_token, "User" AS user_id, amt AS amount, 'USD' AS currency, channel,
"Merchant Name" AS merchant_name, trim("Merchant City") AS merchant_city, CASE WHEN channel = 'online' THEN 'ONLINE' WHEN st = '' THEN 'XX' ELSE st END AS merchant_state,
CASE WHEN channel = 'online' OR st = '' THEN 'XX' WHEN upper(st) IN ({_STATES}) THEN 'US' ELSE CASE st {_CASE} ELSE 'XX' END END AS merchant_country, code AS mcc,
CASE WHEN lower("Zip") IN ('', 'nan') THEN NULL ELSE coalesce(CAST(CAST(TRY_CAST("Zip" AS DOUBLE) AS BIGINT) AS VARCHAR), "Zip") END AS zip, nullif(rtrim("Errors?", ','), '') AS errors,
CASE lower("Is Fraud?") WHEN 'yes' THEN true WHEN 'no' THEN false END AS is_fraud,
CASE WHEN tm IS NULL THEN 'Time: is no time' WHEN amt IS NULL THEN 'Amount: is no number' WHEN code IS NULL THEN 'MCC: is no integer' END AS reason FROM p)"""


@query(f"{_MAPPED} SELECT * FROM mapped")
def ingest_mapping(spark, sf):
    """All sixteen fields of the contract, and why a row can't be an event."""
    return E.to_events(raw_rows(spark, sf), "salt")


@query(f"""{_MAPPED} SELECT reason AS error, count(*) AS n, min(row) AS first_row, max(raw.\"Amount\") AS most
FROM mapped JOIN raw USING (row) WHERE reason IS NOT NULL
GROUP BY 1""")
def dead_letters(spark, sf):
    """Rows that can't be mapped, written as JSON letters and read back."""
    raw, path = raw_rows(spark, sf), shared_folder(spark, "letters")
    mapped = E.to_events(raw, "salt").select("row", "reason").withColumnRenamed("row", "of")
    E.dead_letters(raw.join(mapped, c("row") == c("of")), c("reason"), ["row", *E.RAW_COLUMNS]).write.text(path)
    back = spark.read.schema("raw struct<row bigint, Amount string>, error string").json(path)
    return back.groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.min("raw.row").alias("first_row"), F.max("raw.Amount").alias("most"))


def _candidates(spark, sf) -> DataFrame:
    """Events with all required fields, each broken in some."""
    e, bad = t(spark, sf, "events"), c("event_id") % 16
    at = lambda i, value, usual: F.when(bad == i, value).otherwise(usual)
    return e.select(
        c("event_id").cast("string").alias("event_id"),
        at(1, "2.0", F.lit("1.0.0")).alias("schema_version"),
        at(2, None, F.lit("2024-01-01T00:00:00Z")).alias("event_time"),
        at(3, "xyz", F.sha2(c("user_id").cast("string"), 256)).alias("card_token"),
        at(4, "", c("user_id").cast("string")).alias("user_id"),
        at(5, None, c("value")).alias("amount"),
        at(6, "usd", F.lit("USD")).alias("currency"),
        at(7, "mail", F.lit("chip")).alias("channel"),
        at(8, "", F.lit("shop")).alias("merchant_name"),
        at(9, None, F.lit("town")).alias("merchant_city"),
        at(10, None, F.lit("AZ")).alias("merchant_state"),
        at(11, "usa", F.lit("US")).alias("merchant_country"),
        F.when(bad.isin(12, 4), -1).when(bad == 13, None).otherwise((c("user_id") % 9999).cast("int")).alias("mcc"),
    )


_BROKEN = {
    1: "schema_version: must be 1.0.0", 2: "event_time: is required", 3: "card_token: must be 64 hex digits", 4: "mcc: must be from 0 to 9999", 5: "amount: is required",
    6: "currency: must be three capitals", 7: "channel: is no channel", 8: "merchant_name: is too short", 9: "merchant_city: is required", 10: "merchant_state: is required",
    11: "merchant_country: must be two capitals", 12: "mcc: must be from 0 to 9999", 13: "mcc: is required",
}
_REASON = "SELECT CAST(event_id AS VARCHAR) AS event_id, CASE event_id % 16 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _BROKEN.items()) + " END AS reason FROM events"


@query(_REASON)
def validate_reason(spark, sf):
    x = _candidates(spark, sf)
    return x.select("event_id", S.reason(x.columns).alias("reason"))


@query("""SELECT count(*) FILTER (WHERE event_id % 16 IN (2, 5, 9, 10, 13)) AS quarantined, count(*) FILTER (WHERE event_id % 16 NOT IN (2,
5, 9, 10, 13)) AS passed FROM events""")
def not_null_split(spark, sf):
    """The weaker check of a stream: the twelve fields that must be there, without their rules."""
    x = _candidates(spark, sf)
    return x.agg(F.count_if(~S.complete()).alias("quarantined"), F.count_if(S.complete()).alias("passed"))


@query(f"""SELECT coalesce(reason, 'valid') AS outcome, count(*) AS n, min(CASE WHEN reason IS NULL THEN NULL ELSE '{{\"raw\":{{\"event_id\":\"' || event_id || '\"}},\"error\":\"' || reason || '\"}}' END) AS sample
FROM ({_REASON}) GROUP BY 1""")
def dlq_split(spark, sf):
    x = _candidates(spark, sf)
    x = x.withColumn("reason", S.reason([k for k in x.columns]))
    letter = F.when(c("reason").isNotNull(), F.to_json(F.struct(F.struct("event_id").alias("raw"), c("reason").alias("error"))))
    return x.groupBy(F.coalesce("reason", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.min(letter).alias("sample"))


_MCC = "2950 + CAST(json_extract_string(props, '$.k') AS INT)"
_GROUP = "CASE " + " ".join(f"WHEN {{m}} IN ({', '.join(map(str, v))}) THEN '{k}'" for k, v in X.MCC_GROUPS.items()) + " WHEN {m} BETWEEN 3000 AND 3999 THEN 'travel' ELSE 'other' END"


_ENRICHED = f"""channel = 'online' AS is_cnp, channel = 'chip' AS is_chip, channel = 'swipe' AS is_swipe, merchant_country NOT IN ('US', 'XX') AS is_cross_border, mcc,
{_GROUP.format(m="mcc")} AS mcc_group, CASE {_GROUP.format(m="mcc")} WHEN 'travel' THEN 0 WHEN 'grocery' THEN 1 WHEN 'cash' THEN 2 WHEN 'online_retail' THEN 3 ELSE 4 END AS mcc_group_id,
errors IS NOT NULL AS has_error, round(ln(1 + abs(amount)), 6) AS amount_log"""


@query(f"""{_MAPPED} SELECT row, {_ENRICHED}, CAST(hour(CAST(replace(event_time, 'Z', '') AS TIMESTAMP)) AS INT) AS hour_of_day,
CAST(isodow(CAST(replace(event_time, 'Z', '') AS TIMESTAMP)) - 1 AS INT) AS day_of_week
FROM mapped WHERE reason IS NULL""")
def enrich_events(spark, sf):
    e = E.enriched(E.to_events(raw_rows(spark, sf), "salt").where("reason IS NULL")).withColumn("amount_log", F.round("amount_log", 6))
    return e.select("row", *(x for x in E.EVENT_FEATURES if x != "amount"), "mcc_group")


_PLAIN = f"SELECT *, CASE event_type WHEN 'click' THEN 'chip' WHEN 'view' THEN 'swipe' ELSE 'online' END AS channel, CASE WHEN user_id % 3 = 0 THEN 'IT' ELSE 'US' END AS merchant_country, value AS amount, {_MCC} AS mcc, CASE WHEN event_type = 'error' THEN 'Bad PIN' END AS errors FROM events"


def _feature_sql() -> str:
    w = _pit(*_EV, ["count", "sum", "mean", "rate", "distinct"])
    ints = ", ".join(f"CAST({x} AS INT) AS {x}" for x in ("is_cnp", "is_chip", "is_swipe", "is_cross_border", "has_error"))
    names = [f"txn_count_{x}" for x in W.WINDOWS] + [f"distinct_city_{x} AS distinct_merchant_city_{x}" for x in W.WINDOWS] + [
        f"round({m}_{x}, 6) AS {m}_{x}" for m in ("amount_sum", "amount_mean", "decline_rate") for x in W.WINDOWS
    ]
    since = SQL["time_since_last"]
    return f"""WITH w AS ({w}), l AS ({since}), x AS ({_PLAIN}), e AS (SELECT event_id, ts, amount, {_ENRICHED} FROM x)
SELECT event_id, amount, amount_log, {ints}, mcc, mcc_group_id, CAST(hour(ts) AS INT) AS hour_of_day, CAST(isodow(ts) - 1 AS INT) AS day_of_week, time_since_last_txn_s, CAST(is_new_city_30d AS INT) AS is_new_city_30d,
round(amount / CASE WHEN amount_mean_30d = 0 THEN 1.0 ELSE amount_mean_30d END, 6) AS amount_over_mean_30d, {', '.join(names)} FROM e JOIN w USING (event_id) JOIN l USING (event_id)"""


@query(_feature_sql())
def feature_rows(spark, sf):
    """The whole row that a model reads: 34 columns of each event."""
    kind, mcc = c("event_type"), (2950 + F.get_json_object("props", "$.k").cast("int")).cast("int")
    channel = F.when(kind == "click", "chip").when(kind == "view", "swipe").otherwise("online")
    more = {
        "channel": channel,
        "merchant_country": F.when(c("user_id") % 3 == 0, "IT").otherwise("US"),
        "merchant_city": kind,
        "mcc": mcc,
        "errors": F.when(kind == "error", "Bad PIN"),
        "amount": c("value"),
    }
    rows = E.feature_rows(t(spark, sf, "events").withColumns(more), "user_id", "ts", "event_id", ["event_id"])
    whole = [x for x in E.FEATURES if x.startswith(("amount_", "decline"))]
    return rows.withColumns({x: F.round(x, 6) for x in whole})


@query("SELECT event_id, '…' || right(sha256('salt:' || user_id), 6) AS masked FROM events")
def mask_token(spark, sf):
    return t(spark, sf, "events").select("event_id", X.mask_token(X.token("salt", c("user_id"))).alias("masked"))


@query("""SELECT n_nationkey, CASE r_name WHEN 'EUROPE' THEN 'EU' WHEN 'ASIA' THEN 'AS' ELSE 'XX' END AS code, CASE WHEN n_nationkey % 3 = 0 THEN 'online' WHEN n_nationkey % 3 = 1 THEN 'chip' ELSE 'swipe' END AS channel
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def map_lookups(spark, sf):
    n = t(spark, sf, "nation").join(F.broadcast(t(spark, sf, "region")), c("n_regionkey") == c("r_regionkey"))
    k = c("n_nationkey") % 3
    hot = n.withColumns({"is_cnp": k == 0, "is_chip": k == 1})
    return hot.select(
        "n_nationkey",
        X.lookup({"EUROPE": "EU", "ASIA": "AS"}, c("r_name"), "XX").alias("code"),
        F.when(c("is_cnp"), "online").when(c("is_chip"), "chip").otherwise("swipe").alias("channel"),
    )


# ---- marts and operations


@query(f"""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS txn_date, count(*) AS txn_count, count(*) FILTER (WHERE event_type = 'error') AS fraud_count,
CAST(coalesce(sum({dec('value')}) FILTER (WHERE value > 0), 0) AS DOUBLE) AS amount, count(*) FILTER (WHERE event_type = 'error') / CAST(count(*) AS DOUBLE) AS fraud_rate
FROM events GROUP BY 1 ORDER BY 1""")
def daily_rate(spark, sf):
    bad = F.count_if(c("event_type") == "error")
    return t(spark, sf, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("txn_date")).agg(
        F.count(F.lit(1)).alias("txn_count"),
        bad.alias("fraud_count"),
        F.coalesce(F.sum(F.when(c("value") > 0, c("value").cast("decimal(18,2)"))), F.lit(0)).cast("double").alias("amount"),
        X.ratio(bad, F.count(F.lit(1))).alias("fraud_rate"),
    ).orderBy("txn_date")


@query(f"""SELECT p_type, n_name, count(*) AS txn_count, count(*) FILTER (WHERE l_returnflag = 'R') AS fraud_count, CAST(sum({dec('l_extendedprice')}) AS DOUBLE) / count(*) AS avg_amount
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def merchant_risk(spark, sf):
    place = t(spark, sf, "supplier").join(t(spark, sf, "nation"), c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "n_name")
    x = t(spark, sf, "lineitem").join(t(spark, sf, "part"), c("l_partkey") == c("p_partkey")).join(place, c("l_suppkey") == c("s_suppkey"))
    return x.groupBy("p_type", "n_name").agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.count_if(c("l_returnflag") == "R").alias("fraud_count"),
        (F.sum(c("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("avg_amount"),
    )


@query("""SELECT event_type AS channel, count(*) AS txn_count, count(*) FILTER (WHERE value > 50) AS n_high, count(*) FILTER (WHERE user_id NOT IN (1,
2)) AS n_other, count(*) FILTER (WHERE value > 50) / CAST(count(*) AS DOUBLE) AS share_high, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share
FROM events GROUP BY 1""")
def channel_mix(spark, sf):
    g = t(spark, sf, "events").groupBy(c("event_type").alias("channel")).agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.count_if(c("value") > 50).alias("n_high"),
        F.count_if(~c("user_id").isin(1, 2)).alias("n_other"),
    )
    total = g.agg(F.sum("txn_count").alias("all"))
    return g.join(F.broadcast(total)).select(
        "channel",
        "txn_count",
        "n_high",
        "n_other",
        X.ratio(c("n_high"), c("txn_count")).alias("share_high"),
        X.ratio(c("txn_count"), c("all")).alias("share"),
    )


def _recent(spark, sf, hours: int) -> DataFrame:
    """A scalar subquery, so that the scan can leave out row groups."""
    e = t(spark, sf, "events")
    return e.where(c("ts") >= e.agg((F.max("ts") - F.expr(f"INTERVAL {hours} HOURS")).alias("since")).scalar())


@query("""SELECT date_trunc('minute', ts) AS minute, count(*) AS n
FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS
GROUP BY 1""")
def minute_throughput(spark, sf):
    return _recent(spark, sf, 24).groupBy(
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT date_trunc('minute', ts) AS minute, 100 * count(*) FILTER (WHERE event_type = 'signup') / CAST(nullif(count(*),
0) AS DOUBLE) AS cold_pct FROM events WHERE ts >= (SELECT max(ts)
FROM events) - INTERVAL 24 HOURS GROUP BY 1""")
def cold_share(spark, sf):
    return _recent(spark, sf, 24).groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(
        (100 * F.count_if(c("event_type") == "signup") / F.count(F.lit(1)).cast("double")).alias("cold_pct")
    )


@query("""SELECT (SELECT count(*) FROM events WHERE ts >= m.now - INTERVAL 60 MINUTES) AS scored_last_hour, (SELECT count(*)
FROM orders WHERE o_orderstatus = 'O') AS open_alerts, (SELECT count(*)
FROM events WHERE ts >= m.now - INTERVAL 1 MINUTES) AS last_minute, (SELECT date_diff('second', max(o_orderdate),
m.now) FROM orders) AS staleness_s FROM (SELECT max(ts) AS now
FROM events) m""")
def ops_stats(spark, sf):
    t(spark, sf, "events").createOrReplaceTempView("_events")
    t(spark, sf, "orders").createOrReplaceTempView("_orders")
    return spark.sql(
        "WITH m AS (SELECT max(ts) AS now FROM _events) SELECT (SELECT count(*) FROM _events, m WHERE ts >= now - INTERVAL 60 MINUTES) AS scored_last_hour, (SELECT count(*) FROM _orders WHERE o_orderstatus = 'O') AS open_alerts, (SELECT count(*) FROM _events, m WHERE ts >= now - INTERVAL 1 MINUTES) AS last_minute, (SELECT timestampdiff(SECOND, (SELECT max(o_orderdate) FROM _orders), now) FROM m) AS staleness_s"
    )


@query("SELECT event_id, ts, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def live_feed(spark, sf):
    return t(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts", "user_id", "value")


@query("""SELECT o_orderkey, o_orderdate, c_name, n_name, r_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100""")
def open_alerts(spark, sf):
    top = t(spark, sf, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100)
    x = top.join(t(spark, sf, "customer"), c("o_custkey") == c("c_custkey"), "left").join(
        t(spark, sf, "nation"), c("c_nationkey") == c("n_nationkey"), "left"
    ).join(t(spark, sf, "region"), c("n_regionkey") == c("r_regionkey"), "left")
    return x.select("o_orderkey", "o_orderdate", "c_name", "n_name", "r_name")


@query("""SELECT coalesce(nullif(o_orderstatus, 'P'), 'unknown') AS channel, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY 1""")
def alert_mix(spark, sf):
    x = t(spark, sf, "lineitem").select("l_orderkey").join(
        t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), c("l_orderkey") == c("o_orderkey")
    )
    return x.groupBy(F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("unknown")).alias("channel")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT min(value) AS lo, max(value) AS hi
FROM events) SELECT CAST(least(floor((value - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin, count(*) AS n
FROM events, r GROUP BY 1""")
def score_histogram(spark, sf):
    e = t(spark, sf, "events").select("value")
    r = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.join(F.broadcast(r)).groupBy(
        F.least(F.floor((c("value") - c("lo")) / ((c("hi") - c("lo")) / 30)), F.lit(29)).cast("bigint").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' AND event_type = 'purchase'),
m AS (SELECT min(ts) AS lo FROM b) SELECT event_id FROM events, m
WHERE ts >= lo - INTERVAL 5 DAYS AND ts < lo AND user_id IN (SELECT user_id
FROM b)""")
def semi_history(spark, sf):
    e = t(spark, sf, "events")
    b = e.where("ts >= TIMESTAMP_NTZ '2024-01-29 00:00:00' AND event_type = 'purchase'")
    m = b.agg(F.min("ts").alias("lo"))
    return e.join(
        F.broadcast(m), (c("ts") >= c("lo") - F.expr("INTERVAL 5 DAYS")) & (c("ts") < c("lo"))
    ).join(b.select("user_id"), "user_id", "left_semi").select("event_id")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def anti_dedupe(spark, sf):
    have = t(spark, sf, "orders").where("o_orderstatus = 'F'").select(c("o_orderkey").alias("l_orderkey"))
    return t(spark, sf, "lineitem").select("l_orderkey").dropDuplicates(["l_orderkey"]).join(have, "l_orderkey", "left_anti")


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'),
b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') SELECT 'except' AS op, user_id
FROM (SELECT user_id FROM a EXCEPT SELECT user_id FROM b)
UNION ALL SELECT 'union', user_id FROM (SELECT user_id
FROM a UNION SELECT user_id FROM b)""")
def set_union_except(spark, sf):
    e = t(spark, sf, "events")
    a, b = (e.where(c("event_type") == k).select("user_id") for k in ("error", "signup"))
    tag = lambda k, d: d.select(F.lit(k).alias("op"), "user_id")
    return tag("except", a.subtract(b)).unionByName(tag("union", a.unionByName(b).distinct()))


# ---- drift and ranking

_CUT = "2024-01-21 00:00:00"


def _halves(spark, sf):
    e = t(spark, sf, "events")
    return e.where(f"ts < TIMESTAMP_NTZ '{_CUT}'"), e.where(f"ts >= TIMESTAMP_NTZ '{_CUT}'")


_PSI = "SELECT round(coalesce(sum((c - r) * ln(c / r)), 0), 9) AS psi FROM (SELECT greatest(coalesce(ref, 0) / (SELECT sum(ref) FROM r0), 1e-4) AS r, greatest(coalesce(cur, 0) / (SELECT sum(cur) FROM c0), 1e-4) AS c FROM r0 FULL JOIN c0 USING (bin))"


@query(f"""WITH r0 AS (SELECT event_type AS bin, count(*) AS ref
FROM events WHERE ts < TIMESTAMP '{_CUT}' GROUP BY 1),
c0 AS (SELECT event_type AS bin, count(*) AS cur FROM events
WHERE ts >= TIMESTAMP '{_CUT}' GROUP BY 1) {_PSI}""")
def psi_categorical(spark, sf):
    a, b = _halves(spark, sf)
    return M.psi(M.categories(a, "event_type", "ref"), M.categories(b, "event_type", "cur")).select(F.round("psi", 9).alias("psi"))


@query(f"""WITH q AS (SELECT list_sort(list_distinct(quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e
FROM events WHERE ts < TIMESTAMP '{_CUT}'),
b AS (SELECT ts, (SELECT len(list_filter(e[2:-2], lambda x: x <= value))
FROM q) AS bin FROM events),
r0 AS (SELECT bin, count(*) AS ref FROM b WHERE ts < TIMESTAMP '{_CUT}'
GROUP BY 1),
c0 AS (SELECT bin, count(*) AS cur FROM b WHERE ts >= TIMESTAMP '{_CUT}'
GROUP BY 1) {_PSI}""")
def psi_numeric(spark, sf):
    a, b = _halves(spark, sf)
    return M.drift_table(a, b, ["value"], []).select(F.round("psi", 9).alias("psi"))


_VERDICT = "CASE WHEN psi > 0.2 THEN 'drifted' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS verdict"


@query(f"SELECT 'value' AS feature, psi, {_VERDICT} FROM ({SQL['psi_numeric']}) UNION ALL SELECT 'event_type', psi, {_VERDICT} FROM ({SQL['psi_categorical']})")
def drift_report(spark, sf):
    """What a periodic check says of each column."""
    a, b = _halves(spark, sf)
    return M.drift_table(a, b, ["value"], ["event_type"]).select("feature", F.round("psi", 9).alias("psi"), "verdict")


def _scored(spark, sf) -> DataFrame:
    return t(spark, sf, "labels").join(t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "n_chars", "toxic")


_SC = "WITH x AS (SELECT l.doc_id, n_chars, toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id), p AS (SELECT n_chars AS score, sum(toxic) AS tp, count(*) AS n FROM x GROUP BY 1), k AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER () AS pos, sum(n) OVER () AS tot FROM p WINDOW w AS (ORDER BY score DESC))"


@query(f"""{_SC}, m AS (SELECT count(*) FILTER (WHERE n_chars >= 2000 AND toxic = 1) AS tp, count(*) FILTER (WHERE n_chars >= 2000 AND toxic = 0) AS fp,
count(*) FILTER (WHERE n_chars < 2000 AND toxic = 1) AS fn, count(*) FILTER (WHERE n_chars < 2000 AND toxic = 0) AS tn
FROM x),
r AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE),
0), 0) AS recall FROM m) SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1
FROM r""")
def confusion(spark, sf):
    return M.confusion(_scored(spark, sf), "n_chars", "toxic", 2000)


@query(f"{_SC} SELECT round(sum(tp / CAST(pos AS DOUBLE) * ctp / cn), 9) AS average_precision FROM k")
def avg_precision(spark, sf):
    return M.average_precision(M.curve(_scored(spark, sf), "n_chars", "toxic")).select(
        F.round("average_precision", 9).alias("average_precision")
    )


@query(f"{_SC} SELECT round(sum((n - tp) * ((ctp - tp) + tp / 2.0)) / max(CAST(pos AS DOUBLE) * (tot - pos)), 9) AS roc_auc FROM k")
def roc_auc(spark, sf):
    return M.roc_auc(M.curve(_scored(spark, sf), "n_chars", "toxic")).select(F.round("roc_auc", 9).alias("roc_auc"))


@query(f"{_SC} SELECT score AS threshold, 2.0 * CAST(ctp AS DOUBLE) / (cn + pos) AS f1 FROM k ORDER BY 2 DESC, 1 DESC LIMIT 1")
def pr_threshold(spark, sf):
    return M.best_threshold(M.curve(_scored(spark, sf), "n_chars", "toxic"))


@query(f"""{_SC}, z AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r, greatest(1, round_even((SELECT count(*)
FROM x) * 0.05, 0)) AS k FROM x) SELECT count(*) AS k, avg(CAST(toxic AS DOUBLE)) AS precision
FROM z WHERE r <= k""")
def precision_at_k(spark, sf):
    return M.precision_at(_scored(spark, sf), "n_chars", [F.asc("doc_id")], "toxic", 0.05, tie="doc_id")


_LE = [1, 2.5, 5, 10, 20, 30, 50, 75, 100, 250, 500, 1000]


@query("SELECT q, round(CASE WHEN le = 1e308 THEN lo ELSE lo + (le - lo) * (q * tot - before) / (cnt - before) END, 6) AS value FROM (SELECT q, le, cnt, lo, before, tot, row_number() OVER (PARTITION BY q ORDER BY le) AS r FROM (SELECT le, cnt, coalesce(lag(le) OVER (ORDER BY le), 0) AS lo, coalesce(lag(cnt) OVER (ORDER BY le), 0) AS before, max(cnt) OVER () AS tot FROM (SELECT le, (SELECT count(*) FROM events WHERE value <= le) AS cnt FROM (SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in [*_LE, "1e308"]) + "]) AS le))) CROSS JOIN (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS q) WHERE cnt >= q * tot) WHERE r = 1")
def hist_quantile(spark, sf):
    e = t(spark, sf, "events")
    counts = e.agg(*(F.count_if(c("value") <= x).alias(f"b{i}") for i, x in enumerate(_LE)), F.count(F.lit(1)).alias("b_all"))
    rows = F.explode(
        F.array(
            *(F.struct(F.lit(float(x)).alias("le"), c(f"b{i}").alias("cnt")) for i, x in enumerate(_LE)),
            F.struct(F.lit(float("inf")).alias("le"), c("b_all").alias("cnt")),
        )
    )
    b = counts.select(rows.alias("x")).select("x.le", "x.cnt")
    out = M.histogram_quantile(b, 0.5)
    for q in (0.95, 0.99):
        out = out.unionByName(M.histogram_quantile(b, q))
    return out.select("q", F.round("value", 6).alias("value"))


@query("""SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, round(avg(value), 6) AS mean,
round(stddev_pop(value), 6) AS std FROM events GROUP BY 1""")
def exact_percentiles(spark, sf):
    e = t(spark, sf, "events")
    q = M.quantiles(e, "value", [0.5, 0.95], ["event_type"]).groupBy("event_type").agg(
        *(F.max(F.when(c("share") == x, c("value"))).alias(name) for x, name in ((0.5, "p50"), (0.95, "p95")))
    )
    rest = e.groupBy(c("event_type").alias("of")).agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std")
    )
    return q.join(rest, c("event_type") == c("of")).select("event_type", "p50", "p95", "mean", "std")


# ---- counters, lag, alerts


@query("""WITH s AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n
FROM events GROUP BY 1, 2),
k AS (SELECT *, CAST(sum(n) OVER (PARTITION BY event_type, CAST(h AS DATE)
ORDER BY h) AS BIGINT) AS counter FROM s),
d AS (SELECT *, lag(counter) OVER (PARTITION BY event_type
ORDER BY h) AS was FROM k) SELECT event_type, h, CASE WHEN was IS NULL THEN NULL WHEN counter < was THEN counter ELSE counter - was END / 3600.0::DOUBLE AS rate
FROM d""")
def counter_rate(spark, sf):
    s = t(spark, sf, "events").groupBy(
        "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")
    ).agg(F.count(F.lit(1)).alias("n"))
    k = s.withColumn("counter", F.sum("n").over(Window.partitionBy("event_type", F.to_date("h")).orderBy("h")))
    return M.counter_rates(k, ["event_type"], "h", "counter").select("event_type", "h", (c("rise") / F.lit(3600.0)).alias("rate"))


@query("""WITH s AS (SELECT event_type, date_trunc('minute', ts) AS m, count(*) AS n
FROM events GROUP BY 1, 2),
k AS (SELECT *, CAST(sum(n) OVER (PARTITION BY event_type
ORDER BY m) AS BIGINT) AS counter FROM s) SELECT event_type, m, (counter - min(counter) OVER (PARTITION BY event_type
ORDER BY m RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW)) / 5.0::DOUBLE AS per_minute
FROM k""")
def counter_delta(spark, sf):
    """What a counter has gained in the last five minutes, a minute."""
    s = t(spark, sf, "events").groupBy(
        "event_type", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("m")
    ).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("event_type").orderBy("m")
    k = s.withColumn("counter", F.sum("n").over(by)).withColumn("__us", W.micros(c("m")))
    five = Window.partitionBy("event_type").orderBy("__us").rangeBetween(-300_000_000, 0)
    return k.select("event_type", "m", ((c("counter") - F.min("counter").over(five)) / F.lit(5.0)).alias("per_minute"))


@query("""SELECT event_type AS grp, CAST(sum(greatest(high - CASE WHEN committed >= 0 THEN committed ELSE low END, 0)) AS BIGINT) AS lag
FROM (SELECT event_type, user_id % 8 AS part, max(event_id) AS high, min(event_id) AS low, CASE WHEN user_id % 8 = 0 THEN -1001 ELSE max(event_id) - count(*) END AS committed
FROM events GROUP BY 1, 2, user_id % 8) GROUP BY 1""")
def lag_by_group(spark, sf):
    p = t(spark, sf, "events").groupBy("event_type", (c("user_id") % 8).alias("part")).agg(
        F.max("event_id").alias("high"), F.min("event_id").alias("low"), F.count(F.lit(1)).alias("n")
    )
    p = p.withColumn("committed", F.when(c("part") == 0, F.lit(-1001)).otherwise(c("high") - c("n")))
    return p.groupBy(c("event_type").alias("grp")).agg(
        F.sum(F.greatest(c("high") - F.when(c("committed") >= 0, c("committed")).otherwise(c("low")), F.lit(0))).alias("lag")
    )


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n
FROM events GROUP BY 1),
g AS (SELECT *, row_number() OVER (ORDER BY h) - row_number() OVER (PARTITION BY n > 14
ORDER BY h) AS island FROM h) SELECT min(h) AS since, max(h) AS until, count(*) AS n_hours
FROM g WHERE n > 14 GROUP BY island HAVING count(*) >= 2""")
def alert_hold(spark, sf):
    h = t(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(F.count(F.lit(1)).alias("n"))  # a row for each hour
    g = h.withColumn("island", F.row_number().over(Window.orderBy("h")) - F.row_number().over(Window.partitionBy(c("n") > 14).orderBy("h")))
    return g.where("n > 14").groupBy("island").agg(
        F.min("h").alias("since"), F.max("h").alias("until"), F.count(F.lit(1)).alias("n_hours")
    ).where("n_hours >= 2").drop("island")


# ---- change data capture

_CDC = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 IN (0, 5, 7, 9) THEN 2 WHEN o_orderkey % 10 = 1 THEN 4 WHEN o_orderkey % 10 = 2 THEN 1 WHEN o_orderkey % 10 = 3 THEN 3 ELSE 2 END AS op,
CASE o_orderkey % 20 WHEN 0 THEN true WHEN 5 THEN false END AS fraud, * FROM orders"""


_CDC_EVENTS = f"""WITH x AS ({_CDC}) SELECT lower(printf('%020x', k)) AS lsn, CAST(k AS VARCHAR) AS event_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(epoch_ms(o_orderdate) % 1000 AS BIGINT) AS VARCHAR), 3, '0') || 'Z' AS event_time, sha256('salt:' || o_custkey) AS card_token, o_totalprice AS amount,
'US' AS merchant_country, CAST(k % 10000 AS INT) AS mcc, fraud AS is_fraud FROM x WHERE op = 2"""
_CDC_FIELDS = ["event_id", "event_time", "card_token", "amount", "merchant_country", "mcc", "is_fraud"]


def _change_table(spark, sf) -> DataFrame:
    """orders as a change table."""
    k = c("o_orderkey")
    op = F.when((k % 10).isin(0, 5, 7, 9), 2).when(k % 10 == 1, 4).when(k % 10 == 2, 1).when(k % 10 == 3, 3).otherwise(2)
    return t(spark, sf, "orders").select(
        F.unhex(F.lpad(F.hex(k), 20, "0")).alias("__$start_lsn"),
        op.alias("__$operation"),
        F.lit("1.0.0").alias("schema_version"),
        k.cast("string").alias("event_id"),
        c("o_orderdate").alias("event_time"),
        F.rpad(X.token("salt", c("o_custkey")), 66, " ").alias("card_token"),
        c("o_custkey").cast("string").alias("user_id"),
        c("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.lit("USD ").alias("currency"),
        F.lit("chip").alias("channel"),
        F.lit("US ").alias("merchant_country"),
        (k % 10000).cast("int").alias("mcc"),
        F.when(k % 20 == 0, True).when(k % 20 == 5, False).alias("is_fraud"),
    )


def _wire(table: DataFrame) -> DataFrame:
    """The envelopes of a change table."""
    return CDC.envelopes(table, F.timestamp_seconds(F.lit(0)))


@query(_CDC_EVENTS)
def cdc_envelope_roundtrip(spark, sf):
    """Rows of a change table as envelopes in JSON, and the events that are read from them: inserts only."""
    return CDC.to_events(_wire(_change_table(spark, sf))).where("reason IS NULL").select("lsn", *_CDC_FIELDS)


@query(_CDC_EVENTS)
def stream_cdc(spark, sf):
    """The same from a stream that tails the change table by version: it grows twice, and the query is stopped and goes on each time."""
    table, path, out = _change_table(spark, sf), shared_folder(spark, "changes"), shared_folder(spark, "changed")
    version = F.conv(F.hex("`__$start_lsn`"), 16, 10).cast("bigint")
    top = table.agg(F.max(version)).first()[0] or 0
    for i in range(3):
        changes.write_changes(table.where((version > (top * i // 3 if i else -1)) & (version <= top * (i + 1) // 3)), path)
        rows = changes.tail(spark, path, table.schema)
        done = jobs.run(CDC.to_events(_wire(rows)).where("reason IS NULL"), "changed", out=out)
    return done.select("lsn", *_CDC_FIELDS)


_BROKEN = """CASE o_orderkey % 16 WHEN 0 THEN 'unsupported op: x' WHEN 1 THEN 'missing ''after'' payload' WHEN 2 THEN 'mapping error: amount' WHEN 3 THEN 'unexpected is_fraud value: 2'
WHEN 4 THEN 'mapping error: card_token' WHEN 5 THEN 'unsupported op: null' WHEN 6 THEN 'mapping error: event_time' END"""


@query(f"""WITH x AS (SELECT {_BROKEN} AS reason, o_custkey FROM orders WHERE o_orderkey % 10 NOT IN (1, 2, 3))
SELECT reason, count(*) AS n, count(DISTINCT o_custkey) AS users FROM x WHERE reason IS NOT NULL GROUP BY 1""")
def cdc_rejects(spark, sf):
    """Envelopes of orders that were damaged on their way, with the reason that each is refused for; updates, deletes and other operations aren't among them."""
    k = c("event_id").cast("bigint")
    inserts = _change_table(spark, sf).where("`__$operation` = 2")
    wire = _wire(inserts)
    wire = wire.withColumns({"event_id": F.get_json_object("value", "$.after.event_id"), "user": F.get_json_object("value", "$.after.user_id")})
    swap = lambda pattern, to: F.regexp_replace("value", pattern, to)
    damage = {
        0: swap('"op":"c"', '"op":"x"'),
        1: swap(r'"after":\{[^}]*\}', '"after":null'),
        2: swap(r'"amount":[0-9.E]+', '"amount":"much"'),
        3: swap(r'"is_fraud":[a-z]+', '"is_fraud":2'),
        4: swap(r'"card_token":"[^"]*",', ""),
        5: F.substring("value", 1, 40),
        6: swap(r'"event_time":-?[0-9]+', '"event_time":"noon"'),
    }
    value = c("value")
    for i, text in damage.items():
        value = F.when(k % 16 == i, text).otherwise(value)
    seen = CDC.to_events(wire.select(value.alias("value"), "user")).where("reason IS NOT NULL")
    return seen.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user").alias("users"))


@query("""SELECT o_orderkey, lower(printf('%020x', o_orderkey)) AS lsn, row_number() OVER (ORDER BY o_orderkey // 8, o_custkey,
o_orderkey) AS place FROM orders WHERE o_orderkey // 8 > 12 AND o_orderkey // 8 <= 625""")
def cdc_range_scan(spark, sf):
    """Changes of a range of versions, in the order of (version, sequence)."""
    key = lambda x: F.unhex(F.lpad(F.hex(x), 20, "0"))
    table = t(spark, sf, "orders").select(
        "o_orderkey", key(F.expr("o_orderkey div 8")).alias("__$start_lsn"), F.struct("o_custkey", "o_orderkey").alias("__$seqval")
    )
    got = CDC.changes(table, (12).to_bytes(10, "big"), (625).to_bytes(10, "big"))
    place = F.row_number().over(Window.orderBy("`__$start_lsn`", "`__$seqval`"))  # one range of versions
    return got.select("o_orderkey", F.lower(F.hex(key(c("o_orderkey")))).alias("lsn"), place.cast("bigint").alias("place"))


@query("SELECT o_orderkey, lower(printf('%020x', (o_orderkey + 1) * 256)) AS next_lsn FROM orders")
def lsn_increment(spark, sf):
    """The next version of a ten-byte number, with a carry."""
    before = F.unhex(F.lpad(F.hex((c("o_orderkey") + 1) * 256 - 1), 20, "0"))
    return t(spark, sf, "orders").select("o_orderkey", F.lower(F.hex(CDC.next_lsn(before))).alias("next_lsn"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 7 = 0 THEN 'confirmed_fraud' ELSE o_orderstatus END AS status
FROM orders""")
def alert_status_update(spark, sf):
    alerts = t(spark, sf, "orders").select("o_orderkey", c("o_orderstatus").alias("status"))
    return tables.updated(alerts, "status", "confirmed_fraud", (c("status") == "O") & (c("o_orderkey") % 7 == 0))


_PAIRS = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS u, CAST(event_id % 7 AS VARCHAR) AS card FROM events"
_CARDS = f"""SELECT 'card' AS dim, sha256('salt:' || u || ':' || card) AS id, 'acct-' || u AS parent, ['credit', 'debit', 'prepaid'][CAST(card AS INT) % 3 + 1] AS detail, CAST(NULL AS DOUBLE) AS amount,
CAST(DATE '2010-01-01' + CAST(card AS INT) AS TIMESTAMP) AS since, CAST(row_number() OVER (ORDER BY length(u), u, length(card), card) AS BIGINT) AS place FROM ({_PAIRS})"""


@query(f"""WITH u AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS u FROM events), p AS (SELECT u, CAST(row_number() OVER (ORDER BY length(u), u) AS BIGINT) AS place FROM u)
SELECT 'customer' AS dim, u AS id, NULL AS parent, 'standard' AS detail, CAST(NULL AS DOUBLE) AS amount, TIMESTAMP '2010-01-01' AS since, place FROM p
UNION ALL SELECT 'account', 'acct-' || u, u, 'active', CAST(1000 * (1 + CAST(u AS BIGINT) % 20) AS DOUBLE), TIMESTAMP '2010-01-01', place FROM p UNION ALL {_CARDS}""")
def derive_dims(spark, sf):
    """Customers, accounts and cards from the users and cards of a file, each written after what it refers to, and read back."""
    pairs = t(spark, sf, "events").select(c("user_id").cast("string").alias("User"), (c("event_id") % 7).cast("string").alias("Card"))
    out = None
    for name, rows in D.dimensions(pairs, "salt").items():
        path = shared_folder(spark, name)
        rows.write.mode("overwrite").parquet(path)
        back = spark.read.parquet(path).select(F.lit(name).alias("dim"), "id", "parent", "detail", "amount", "since", "place")
        out = back if out is None else out.unionByName(back)
    return out


@query("""WITH u AS (SELECT DISTINCT user_id AS u FROM events), k AS (SELECT DISTINCT user_id AS u, event_id % 7 AS card FROM events)
SELECT 'orphan_account' AS check, (SELECT count(*) FROM u WHERE u % 17 = 3 AND u % 13 <> 5) AS violations
UNION ALL SELECT 'orphan_card', (SELECT count(*) FROM k WHERE u % 13 = 5 AND NOT (u % 5 = 2 AND card = 4))
UNION ALL SELECT 'unknown_token', (SELECT count(*) FROM events WHERE user_id % 5 = 2 AND event_id % 7 = 4)""")
def dim_parity(spark, sf):
    """Accounts without their customer, cards without their account, and events of unknown cards, in dimensions that are stored and lack some rows."""
    pairs = t(spark, sf, "events").select(c("user_id").cast("string").alias("User"), (c("event_id") % 7).cast("string").alias("Card"))
    dims = D.dimensions(pairs, "salt")
    number = lambda name: c(name).cast("bigint")
    gone = X.token("salt", c("User"), c("Card")).alias("id")
    lost = pairs.where((number("User") % 5 == 2) & (c("Card") == "4")).select(gone).distinct()
    stored = {
        "customer": _kept(dims["customer"].where(number("id") % 17 != 3), "customer"),
        "account": _kept(dims["account"].where(number("parent") % 13 != 5), "account"),
        "card": _kept(dims["card"].join(lost, "id", "left_anti"), "card"),
    }
    parts = [
        tables.violations(stored["account"], parents={"parent": stored["customer"].select("id")}).withColumn("check", F.lit("orphan_account")),
        tables.violations(stored["card"], parents={"parent": stored["account"].select("id")}).withColumn("check", F.lit("orphan_card")),
        tables.violations(pairs.select(X.token("salt", c("User"), c("Card")).alias("id")), parents={"id": stored["card"].select("id")}).withColumn("check", F.lit("unknown_token")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_LEVEL = "SELECT b // 1000 AS b, sha256(string_agg(b || ':' || h, chr(10) ORDER BY b)) AS h FROM {} GROUP BY 1"


@query(f"""WITH l0 AS (SELECT c_custkey // 1000 AS b, sha256(string_agg(c_custkey || ':' || c_name, chr(10)
ORDER BY c_custkey)) AS h FROM customer GROUP BY 1),
l1 AS ({_LEVEL.format('l0')}),
l2 AS ({_LEVEL.format('l1')}) SELECT sha256(string_agg(b || ':' || h, chr(10)
ORDER BY b)) AS fingerprint FROM l2""")
def fingerprint(spark, sf):
    """A tree of digests over ranges of the key: no group holds more than a thousand lines, up to 10**12 keys."""
    g = t(spark, sf, "customer").select(c("c_custkey").alias("b"), c("c_name").alias("h"))
    digest = F.sha2(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda r: F.concat_ws(":", r["b"], r["h"])), "\n"), 256
    )
    for _ in range(3):
        g = g.groupBy(F.expr("b div 1000").alias("__up")).agg(digest.alias("h")).withColumnRenamed("__up", "b")
    return g.agg(digest.alias("fingerprint"))


@query("""SELECT 'event_id_null' AS check, count(*) FILTER (WHERE event_id IS NULL) AS violations
FROM events UNION ALL SELECT 'event_id_unique', count(*)
FROM (SELECT event_id FROM events GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'event_type_accepted', count(*) FILTER (WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup'))
FROM events UNION ALL SELECT 'orphan_custkey', count(*)
FROM orders WHERE o_custkey NOT IN (SELECT c_custkey
FROM customer) UNION ALL SELECT 'rate_range', count(*)
FROM lineitem WHERE l_discount IS NULL OR l_discount < 0 OR l_discount > 0.05""")
def dq_report(spark, sf):
    e, li = t(spark, sf, "events"), t(spark, sf, "lineitem")
    accepted = {"event_type": ["click", "view", "purchase", "signup"]}
    orphans = tables.violations(
        t(spark, sf, "orders"), parents={"o_custkey": t(spark, sf, "customer").select("c_custkey")}
    ).withColumn("check", F.lit("orphan_custkey"))
    rate = li.agg(
        F.count_if(c("l_discount").isNull() | ~c("l_discount").between(0, 0.05)).alias("violations")
    ).select(F.lit("rate_range").alias("check"), "violations")
    return tables.violations(e, required=["event_id"], unique=["event_id"], accepted=accepted).unionByName(orphans).unionByName(rate)


@query("""SELECT n_nationkey, split_part(x, ':', 1) AS grp, split_part(x, ':', 2) AS topic
FROM (SELECT n_nationkey, unnest(string_split('a:' || n_name || ',b:t' || n_nationkey, ',')) AS x
FROM nation)""")
def spec_explode(spark, sf):
    spec = F.concat(F.lit("a:"), c("n_name"), F.lit(",b:t"), c("n_nationkey"))
    x = t(spark, sf, "nation").select("n_nationkey", F.explode(F.split(spec, ",")).alias("x"))
    return x.select(
        "n_nationkey", F.split_part("x", F.lit(":"), F.lit(1)).alias("grp"), F.split_part("x", F.lit(":"), F.lit(2)).alias("topic")
    )


@query("""SELECT event_id, event_type, value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS props
FROM events WHERE event_id % 11 <> 5""")
def avro_roundtrip(spark, sf):
    """Encode, frame, damage some, decode: damaged ones are dropped."""
    schema = T.StructType(
        [
            T.StructField("event_id", T.LongType(), False),
            T.StructField("event_type", T.StringType(), False),
            T.StructField("value", T.DoubleType(), False),
            T.StructField("props", T.StringType()),
        ]
    )
    e = t(spark, sf, "events").withColumn("props", F.when(c("event_id") % 3 == 0, None).otherwise(c("props")))
    framed = e.select(avro.encode(schema, 7, *(c(f.name) for f in schema)).alias("v"), "event_id")
    damaged = framed.select(F.when(c("event_id") % 11 == 5, F.substring("v", 1, 9)).otherwise(c("v")).alias("v"))
    return damaged.select(avro.decode(schema, c("v"), 7).alias("r")).where("r.ok").select(
        "r.event_id", "r.event_type", "r.value", "r.props"
    )


@query("""SELECT 'requests_total' AS metric, event_type AS type, CAST(count(*) AS DOUBLE) AS total
FROM events GROUP BY 2 UNION ALL SELECT 'latency_bucket', NULL, CAST(count(*) + count(*) FILTER (WHERE value <= 10) AS DOUBLE)
FROM events""")
def prom_parse(spark, sf):
    """Counters written as a text exposition, read back, and summed by metric and label."""
    path, e = shared_folder(spark, "metrics"), t(spark, sf, "events")
    line = lambda name, labels, n: F.concat(F.lit(f"{name}{{"), *labels, F.lit("} "), n.cast("string")).alias("value")
    total = e.groupBy("event_type", "user_id").count()
    lines = total.select(
        line("requests_total", [F.lit('type="'), c("event_type"), F.lit('",user="'), c("user_id").cast("string"), F.lit('"')], c("count"))
    )
    buckets = e.agg(F.count_if(c("value") <= 10).alias("low"), F.count(F.lit(1)).alias("all"))
    for le, n in (("10", "low"), ("+Inf", "all")):
        lines = lines.unionByName(buckets.select(line("latency_bucket", [F.lit(f'le="{le}"')], c(n))))
    lines.unionByName(spark.createDataFrame([("# TYPE requests_total counter",), ("no sample",)], "value string")).write.text(path)
    got = tables.samples(spark.read.text(path))
    return got.groupBy("metric", F.try_element_at("labels", F.lit("type")).alias("type")).agg(F.sum("value").alias("total"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, CAST(count(*) AS BIGINT) AS versions FROM orders GROUP BY 1")
def keyed_upsert(spark, sf):
    """Latest rows by key, upserted in three snapshots, each written to a place of its own."""
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.lit(1).cast("bigint").alias("versions"))
    stored = o.limit(0)
    for i in range(3):
        part, path = o.where(c("o_orderkey") % 3 == i), shared_folder(spark, "snapshot")
        # of a batch's rows of a key the last counts, and says how many there were
        part = part.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.sum("versions").alias("versions"))
        was = stored.select(c("o_custkey").alias("k"), c("versions").alias("was"))
        seen = part.join(was, c("o_custkey") == c("k"), "left").select(
            "o_custkey", "o_orderkey", (c("versions") + F.coalesce("was", F.lit(0))).alias("versions")
        )
        low = stored.select(c("o_custkey").alias("k"), c("o_orderkey").alias("least"))
        seen = seen.join(low, c("o_custkey") == c("k"), "left").select(
            "o_custkey", F.greatest("o_orderkey", "least").alias("o_orderkey"), "versions"
        )
        tables.upserted(stored, seen, "o_custkey", "versions").write.parquet(path)
        stored = spark.read.parquet(path)
    return stored


@query("SELECT event_id, value FROM events")
def append_new_rows(spark, sf):
    """Three overlapping deliveries, appended without copies."""
    e, path = t(spark, sf, "events").select("event_id", "value"), shared_folder(spark, "appended")
    for i in range(3):
        tables.append_new(e.where((c("event_id") % 3 == i) | (c("event_id") % 5 == 0)), path, "event_id")
    return spark.read.parquet(path)


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE event_id % 11 = 5) AS poison, count(*) FILTER (WHERE event_id % 11 <> 5) AS decoded
FROM events""")
def poison_counts(spark, sf):
    """How many framed records couldn't be decoded, counted while the others are written."""
    schema = T.StructType([T.StructField("event_id", T.LongType(), False), T.StructField("value", T.DoubleType(), False)])
    framed = t(spark, sf, "events").select(avro.encode(schema, 7, c("event_id"), c("value")).alias("v"), "event_id")
    damaged = framed.select(F.when(c("event_id") % 11 == 5, F.substring("v", 1, 9)).otherwise(c("v")).alias("v"))
    rows, seen = tables.counted(damaged.select(avro.decode(schema, c("v"), 7).alias("r")), poison=c("r").isNull() | ~c("r.ok"))
    rows.where("r.ok").select("r.event_id", "r.value").write.parquet(shared_folder(spark, "decoded"))
    n = seen.get
    return spark.createDataFrame([(n["rows"], n["poison"], n["rows"] - n["poison"])], "rows bigint, poison bigint, decoded bigint")


@query(f"""WITH s AS (SELECT user_id, count(*) AS n, CAST(sum({dec('value')}) AS DOUBLE) AS total
FROM events WHERE ts < TIMESTAMP '{_CUT}' GROUP BY 1),
p AS (SELECT event_id, s.user_id IS NULL AS cold_card, least(1.0, greatest(0.0, round(0.002 * value + 0.1 * coalesce(value / nullif(total / n,
0), 0), 9))) AS p FROM events e LEFT JOIN s ON e.user_id = s.user_id
WHERE ts >= TIMESTAMP '{_CUT}') SELECT event_id, cold_card, p AS fraud_probability, CASE WHEN p >= 0.25 THEN 'review' ELSE 'approve' END AS decision
FROM p""")
def score_join(spark, sf):
    past, now = _halves(spark, sf)
    state = past.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(c("value").cast("decimal(18,2)")).cast("double").alias("total"))
    x = now.join(state, "user_id", "left")
    p = F.least(
        F.lit(1.0),
        F.greatest(F.lit(0.0), F.round(0.002 * c("value") + 0.1 * F.coalesce(F.try_divide(c("value"), c("total") / c("n")), F.lit(0.0)), 9)),
    )
    x = x.select("event_id", c("n").isNull().alias("cold_card"), p.alias("fraud_probability"))
    return x.withColumn(
        "decision",
        F.when(c("fraud_probability") >= F.coalesce(F.lit(None).cast("double"), F.lit(0.25), F.lit(1.0)), "review").otherwise("approve"),
    )


@query("""SELECT event_id, ts, user_id FROM events WHERE user_id IN (SELECT user_id
FROM events WHERE event_type = 'signup') ORDER BY ts DESC, event_id DESC LIMIT 5000""")
def recent_sample(spark, sf):
    e = t(spark, sf, "events")
    return e.join(
        e.where("event_type = 'signup'").select("user_id"), "user_id", "left_semi"
    ).orderBy(F.desc("ts"), F.desc("event_id")).limit(5000).select("event_id", "ts", "user_id")


@query("""SELECT user_id, count(*) AS n_rows, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS is_fraud, max(ts) AS last_ts,
min(ts) AS first_ts FROM events GROUP BY 1""")
def partial_final(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.when(c("event_type") == "error", 1).otherwise(0)).alias("is_fraud"),
        F.max("ts").alias("last_ts"),
        F.min("ts").alias("first_ts"),
    )


# ---- files, sampling, models


@query(f"{_MAPPED} SELECT * FROM mapped WHERE reason IS NULL")
def csv_roundtrip(spark, sf):
    """Written as CSV, read with a declared schema, filtered by year before anything is parsed."""
    path = shared_folder(spark, "csv")
    raw = raw_rows(spark, sf)
    raw.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return tables.load_events(spark, path, raw.schema, "salt", since=2013, until=2030).where("reason IS NULL")


@query(f"""WITH raw AS ({_RAW}), m AS (SELECT *, CASE WHEN row % 31 = 7 THEN '12345' WHEN row % 37 = 8 THEN '-1' ELSE "MCC" END AS code, CASE WHEN row % 41 = 9 THEN 'n/a' ELSE "Year" END AS yr FROM raw),
r AS (SELECT row, CASE WHEN TRY_CAST(yr AS INT) IS NULL THEN 'Year: is no year' WHEN TRY_CAST(yr || '-' || "Month" || '-' || "Day" || ' ' || "Time" || ':00' AS TIMESTAMP) IS NULL THEN 'Time: is no time'
WHEN TRY_CAST(replace("Amount", '$', '') AS DOUBLE) IS NULL THEN 'Amount: is no number' WHEN TRY_CAST(code AS INT) IS NULL THEN 'MCC: is no integer' WHEN TRY_CAST(code AS INT) NOT BETWEEN 0 AND 9999 THEN 'MCC: must be from 0 to 9999' END AS reason FROM m)
SELECT reason, count(*) AS n, min(row) AS first_row FROM r GROUP BY 1""")
def csv_skips(spark, sf):
    """Rows of a CSV file that are events (no reason) or are skipped, by reason; a row without a year can't be told to lie within the years."""
    path, row = shared_folder(spark, "csv"), c("row")
    raw = raw_rows(spark, sf).withColumns({
        "MCC": F.when(row % 31 == 7, "12345").when(row % 37 == 8, "-1").otherwise(c("MCC")),
        "Year": F.when(row % 41 == 9, "n/a").otherwise(c("Year")),
    })
    raw.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    seen = tables.load_events(spark, path, raw.schema, "salt", since=2013, until=2030)
    return seen.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))


@query("""WITH u AS (SELECT user_id, max(CASE WHEN event_type = 'error' AND value > 100 THEN 1 ELSE 0 END) AS bad
FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY bad
ORDER BY md5('42:' || user_id), user_id) AS r FROM u) SELECT user_id, bad
FROM r WHERE r <= CASE WHEN bad = 1 THEN 60 ELSE 40 END""")
def seeded_sample(spark, sf):
    u = t(spark, sf, "events").groupBy("user_id").agg(
        F.max(F.when((c("event_type") == "error") & (c("value") > 100), 1).otherwise(0)).alias("bad")
    )
    pick = lambda bad, n: u.where(c("bad") == bad).orderBy(F.md5(F.concat(F.lit("42:"), c("user_id")).cast("binary")), "user_id").limit(n)
    return pick(1, 60).unionByName(pick(0, 40))


def _split_rows(spark, sf) -> DataFrame:
    """Features and split of each event: the first 64 % train, up to 80 % validate, the others test."""
    e = t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    x = W.trailing(
        e, "user_id", "ts", "event_id", "value", c("event_type") == "error", "event_type", {"1d": 86_400, "7d": 604_800}, distinct=False
    )
    n = e.count()
    split = F.when(c("__pos") <= int(int(n * 0.8) * 0.8), "train").when(c("__pos") <= int(n * 0.8), "validation").otherwise("test")
    return W.positions(x, "ts", "event_id").withColumns({"label": (c("event_type") == "error").cast("double"), "split": split})


_MODEL_FEATURES = ["value", *(f"{m}_{w}" for w in ("1d", "7d") for m in ("txn_count", "amount_sum", "amount_mean", "decline_rate"))]


@query("""WITH p AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS pos, count(*) OVER () AS n FROM events),
s AS (SELECT *, event_type = 'error' AS bad, CASE WHEN pos <= floor(floor(n * 0.8) * 0.8) THEN 'train' WHEN pos <= floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM p),
w AS (SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'validation') AS n_validation, count(*) FILTER (WHERE split = 'test') AS n_test,
coalesce(count(*) FILTER (WHERE split = 'train' AND NOT bad) / CAST(nullif(count(*) FILTER (WHERE split = 'train' AND bad), 0) AS DOUBLE), 1.0) AS class_weight,
count(*) FILTER (WHERE split = 'test' AND bad) AS n_bad, count(*) FILTER (WHERE split = 'test' AND NOT bad) AS n_good FROM s)
SELECT event_id, bad, true AS is_probability, true AS as_printed, true AS decided_by_threshold, w.* FROM s, w WHERE split = 'test'""")
def gbt_scores(spark, sf):
    """Boosted trees on point-in-time features, with early stop on validation rows: sizes of the splits, the weight of a positive row, and of each test row
    whether its score is a probability, is what the printed trees give, and falls on the side of the threshold that its cell of the confusion counts says."""
    from cardlake.operators import model as B

    x = _split_rows(spark, sf).where("ts IS NOT NULL")
    x = _kept(x.select("event_id", "split", "label", *_MODEL_FEATURES), "rows")
    known = x.where("split <> 'test'").withColumn("held", c("split") == "validation")
    model = B.fit(known, _MODEL_FEATURES, validation="held", maxIter=5, maxDepth=4)
    done = _kept(B.scored(model, x.where("split = 'test'")).withColumn("printed", F.expr(B.expression(model))), "scored")
    points = M.curve(B.scored(model, x.where("split = 'validation'")).select("probability", c("label").cast("int").alias("y")), "probability", "y")
    best = M.best_threshold(points).first()
    threshold = best["threshold"] if best and best["f1"] is not None else 1.0
    cells = M.confusion(done, "probability", "label", threshold).first()
    part = lambda name, bad=None: F.count_if((c("split") == name) if bad is None else (c("split") == name) & (c("label") == bad))
    sizes = x.agg(part("train").alias("n_train"), part("validation").alias("n_validation"), part("test").alias("n_test"), part("train", 0).alias("good"), part("train", 1).alias("bad_rows")).first()
    weight = sizes["good"] / sizes["bad_rows"] if sizes["bad_rows"] else 1.0
    review = c("probability") >= threshold
    cell = F.when(review, F.when(c("label") == 1, "tp").otherwise("fp")).otherwise(F.when(c("label") == 1, "fn").otherwise("tn"))
    mine = done.groupBy(cell.alias("cell")).count().collect()  # four rows
    agrees = {r["cell"]: r["count"] for r in mine} == {k: cells[k] for k in ("tp", "fp", "fn", "tn") if cells[k]}
    return done.select(
        "event_id",
        (c("label") == 1).alias("bad"),
        c("probability").between(0, 1).alias("is_probability"),
        (F.abs(c("probability") - c("printed")) < 1e-9).alias("as_printed"),
        F.lit(agrees).alias("decided_by_threshold"),
        *(F.lit(sizes[k]).cast("bigint").alias(k) for k in ("n_train", "n_validation", "n_test")),
        F.lit(float(weight)).alias("class_weight"),
        F.lit(cells["tp"] + cells["fn"]).cast("bigint").alias("n_bad"),
        F.lit(cells["fp"] + cells["tn"]).cast("bigint").alias("n_good"),
    )


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """rows, written once and read from there."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


# ---- stored tables, versions of models, what is left of a template


@query(f"""{_MAPPED}, s AS (SELECT *, round(least(1.0, 0.004 * abs(amount)), 9) AS p FROM mapped WHERE reason IS NULL)
SELECT 'transaction' AS kind, event_id, CAST(event_time AS TIMESTAMP) AS event_time, amount, merchant_country AS detail, NULL::DOUBLE AS fraud_probability, NULL::BOOLEAN AS cold_card FROM s
UNION ALL SELECT 'scored', event_id, CAST(event_time AS TIMESTAMP), amount, CASE WHEN p >= 0.3 THEN 'review' ELSE 'approve' END, p, CASE WHEN is_fraud IS NULL THEN false ELSE is_fraud END FROM s
UNION ALL SELECT 'alert', event_id, NULL, amount, merchant_name, p, NULL FROM s WHERE p >= 0.3""")
def stored_rows(spark, sf):
    """Events as rows of the tables of transactions, scores and alerts, appended to tables that are defined if they are missing, and read back."""
    events = E.to_events(raw_rows(spark, sf), "salt").where("reason IS NULL")
    p = F.round(F.least(F.lit(1.0), 0.004 * F.abs("amount")), 9)
    scored = events.withColumns({"fraud_probability": p, "threshold": F.lit(0.3), "cold_card": c("is_fraud")})
    scored = scored.withColumn("decision", F.when(c("fraud_probability") >= c("threshold"), "review").otherwise("approve"))
    rows = {"transactions": E.transaction_rows(events), "scores": E.scored_rows(scored), "alerts": E.alert_rows(scored)}
    base = f"stored_{shared_folder(spark, 'x')[-32:]}"
    spark.sql(f"CREATE DATABASE {base} LOCATION '{shared_folder(spark, base)}'")
    shapes = {name: x.schema for name, x in rows.items()}
    made = tables.create_missing(spark, shapes, base), tables.create_missing(spark, shapes, base)
    if made != (list(rows), []):
        raise ValueError(f"tables were defined twice: {made}")
    for name, x in rows.items():
        x.write.mode("append").format("parquet").insertInto(f"{base}.{name}")
    read = {name: spark.table(f"{base}.{name}") for name in rows}
    text, yes, no = "string", F.lit(None).cast("boolean"), F.lit(None)
    time = c("event_time").cast("timestamp_ntz")
    return (
        read["transactions"].select(F.lit("transaction").alias("kind"), "event_id", time.alias("event_time"), "amount", c("merchant_country").alias("detail"), no.cast("double").alias("fraud_probability"), yes.alias("cold_card"))
        .unionByName(read["scores"].select(F.lit("scored").alias("kind"), "event_id", time.alias("event_time"), "amount", c("decision").alias("detail"), "fraud_probability", "cold_card"))
        .unionByName(read["alerts"].select(F.lit("alert").alias("kind"), "event_id", no.cast("timestamp_ntz").alias("event_time"), "amount", c("merchant_name").cast(text).alias("detail"), "fraud_probability", yes.alias("cold_card")))
    )


@query(f"""WITH u AS (SELECT DISTINCT user_id FROM events), s AS ({SQL["latest_card_state"]})
SELECT user_id, {", ".join(f"CAST(coalesce(txn_count_{n}, 0) AS DOUBLE) AS txn_count_{n}, coalesce(amount_sum_{n}, 0.0) AS amount_sum_{n}" for n in W.WINDOWS)}, 0.0::DOUBLE AS decline_rate_7d, {len(E.FEATURES)} AS n_features
FROM u LEFT JOIN (SELECT * FROM s WHERE user_id % 3 <> 1) USING (user_id)""")
def online_rows(spark, sf):
    """A model's inputs, in its order, from the stored state of each user: zeros for users without one, and for windows that aren't stored."""
    e = t(spark, sf, "events")
    known = W.latest_state(e, "user_id", "ts", "value").where(c("user_id") % 3 != 1)
    rows = E.online_row(e.select("user_id").distinct().join(known, "user_id", "left").drop("last_event_ts"))
    n = F.lit(len([x for x in rows.columns if x in E.FEATURES]))
    return rows.select("user_id", *(f"{m}_{w}" for w in W.WINDOWS for m in ("txn_count", "amount_sum")), "decline_rate_7d", n.alias("n_features"))


@query("""SELECT p.pointer, p.version, p.threshold, count(*) FILTER (WHERE event_type = p.kind) AS n_review, count(*) AS n FROM events, (VALUES ('none', 'v1', CAST(0.4 AS DOUBLE), 'purchase'), ('v2', 'v2', 0.6, 'view'), ('gone', 'v1', 0.4, 'purchase')) AS p(pointer, version, threshold, kind)
GROUP BY 1, 2, 3""")
def model_versions(spark, sf):
    """Events that the current model would review: before there is a pointer the fallback's, then the version's that the pointer names, and the fallback's again when that version is gone."""
    from cardlake.operators import model as B

    e = t(spark, sf, "events")
    kinds = {"purchase": "is_purchase", "view": "is_view"}
    rows = e.withColumns({x: (c("event_type") == k).cast("double") for k, x in kinds.items()})
    learned = {x: B.fit(rows.where(c("event_id") % 5 == 0).withColumn("label", c(x)), list(kinds.values()), maxIter=2, maxDepth=2) for x in kinds.values()}
    folder, made = shared_folder(spark, "models"), None
    B.save(learned["is_purchase"], folder, "v1", threshold=0.4, point=False)
    for pointer in ("none", "v2", "gone"):
        if pointer == "v2":
            B.save(learned["is_view"], folder, "v2", threshold=0.6)
        if pointer == "gone":
            B.make_current(spark, folder, "v3")
        model, told = B.load_current(spark, folder, fallback="v1")
        review = F.count_if(c("probability") >= told["threshold"])
        row = B.scored(model, rows).agg(review.alias("n_review"), F.count(F.lit(1)).alias("n")).select(
            F.lit(pointer).alias("pointer"), F.lit(told["version"]).alias("version"), F.lit(told["threshold"]).alias("threshold"), "n_review", "n"
        )
        made = row if made is None else made.unionByName(row)
    return made


_PICK = "{}[CAST(CAST('0x' || substr(md5('seed:' || c_custkey), {}, 8) AS BIGINT) % {} + 1 AS INT)]"


@query(f"SELECT c_custkey, {_PICK.format(X.GIVEN, 1, len(X.GIVEN))} || ' ' || {_PICK.format(X.FAMILY, 9, len(X.FAMILY))} AS name FROM customer")
def made_up_names(spark, sf):
    """Names of customers that tell nothing of them."""
    return t(spark, sf, "customer").select("c_custkey", X.made_up_name(c("c_custkey"), "seed").alias("name"))


@query("""SELECT s_suppkey, 'https://' || lower(replace(s_name, '#', '')) || '.example/' || CAST(s_nationkey AS VARCHAR) || '?key=${KEY}' AS url FROM supplier""")
def filled_templates(spark, sf):
    """Placeholders of a template that have a value for the row are filled; others stay."""
    s = t(spark, sf, "supplier").withColumn("url", F.lit("https://${HOST}.example/${NATION}?key=${KEY}"))
    values = {"HOST": F.lower(F.replace("s_name", F.lit("#"), F.lit(""))), "NATION": c("s_nationkey").cast("string"), "NOTHING": "x"}
    return s.select("s_suppkey", X.filled(c("url"), values).alias("url"))


# ---- streams: the events come in several files, one a trigger, and some of them twice

_FILES = 5


def _stream(spark, sf, again: bool = True, **how):
    e = t(spark, sf, "events")
    wide, twice = jobs.width(e, _FILES), c("event_id") % 7 == 0
    return jobs.source(spark, jobs.replay(e, "ts", _FILES, again=twice if again else None, wide=wide, **how), e.schema, "ts", wide)


def _deliveries(spark, sf, n: int = 4, rows: DataFrame | None = None) -> tuple[str, DataFrame]:
    """A folder of n deliveries of events, by the remainder of event_id, and its stream: a delivery a trigger."""
    e, folder = t(spark, sf, "events") if rows is None else rows, shared_folder(spark, "deliveries")
    wide = jobs.width(e, n)
    for i in range(n):
        jobs.deliver(e.where(c("event_id") % n == i), folder, wide)
    return folder, jobs.source(spark, folder, e.schema, "ts", wide)


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n
FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts)
FROM events) - INTERVAL 10 MINUTES GROUP BY 1, 2""")
def stream_tumbling(spark, sf):
    done = jobs.run(jobs.tumbling(_stream(spark, sf, again=False), "ts", "event_type", "1 hour", "10 minutes"), "tumbling")
    return done.select(c("start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("SELECT event_id, event_type, value FROM events")
def stream_dedupe(spark, sf):
    return jobs.run(jobs.deduplicated(_stream(spark, sf), "ts", "event_id"), "deduplicated").select("event_id", "event_type", "value")


@query(_pit(*_EV, ["count", "sum"]))
def stream_features(spark, sf):
    """Some events come twice, the second time with another time of their own, and some late: what was written before them is corrected."""
    out = shared_folder(spark, "features")
    jobs.features(_stream(spark, sf, again_at=c("ts") + F.expr("INTERVAL 3 DAYS"), late=c("event_id") % 11 == 3), out)
    return jobs.current_features(spark, out).select("event_id", *(f"{m}_{w}" for w in W.WINDOWS for m in ("txn_count", "amount_sum")))


@query("""SELECT event_id, user_id, round(least(1.0, 0.004 * value), 9) AS fraud_probability, CAST(value AS DOUBLE) AS amount,
'open' AS status, ts AS created_at FROM events WHERE round(least(1.0, 0.004 * value), 9) >= 0.3""")
def stream_alerts(spark, sf):
    """One alert for each event, though some come twice, the second time a day later by their own time."""
    out = shared_folder(spark, "scoring")
    score = lambda rows: rows.withColumn("fraud_probability", F.round(F.least(F.lit(1.0), 0.004 * c("value")), 9))
    jobs.scoring(_stream(spark, sf, again_at=c("ts") + F.expr("INTERVAL 1 DAY")), score, 0.3, out)
    done = spark.read.parquet(f"{out}/alerts").withColumn("created_at", c("created_at").cast("timestamp_ntz"))
    return done.select("event_id", "user_id", "fraud_probability", "amount", "status", "created_at")


@query(f"SELECT user_id, count(*) AS n, CAST(sum({dec('value')}) AS DOUBLE) AS total FROM events GROUP BY 1")
def stream_state(spark, sf):
    return jobs.running_totals(_stream(spark, sf, again=False)).select("user_id", "n", "total")


@query(SQL["alert_hold"])
def stream_alert_hold(spark, sf):
    """Alerts of hours with many events, two or more on end, from samples in three deliveries; the query is stopped and goes on between them."""
    h = t(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    folder, out = shared_folder(spark, "samples"), shared_folder(spark, "held")
    with jobs.rocks(spark):
        for part in jobs.parts(h, "h", 3):
            part.coalesce(1).write.mode("append").parquet(folder)
            told = alerts.held(jobs.source(spark, folder, h.schema, "h"), "h", F.lit("busy"), c("n") > 14, "1 hour", "0 seconds")
            done = jobs.run(told, "held", out=out)
    found = alerts.alerts(done)
    return found.select(*(c(x).cast("timestamp_ntz").alias(x) for x in ("since", "until")), c("n").alias("n_hours"))


_BEFORE = "OVER (PARTITION BY user_id ORDER BY event_id % 4 RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_STATE = f"SELECT *, CAST(event_id % 4 AS INT) AS batch, count(*) {_BEFORE} AS n, CAST(sum({dec('value')}) {_BEFORE} AS DOUBLE) AS total FROM events"


def _growing_state(spark, sf) -> tuple[DataFrame, state.Snapshots, Callable[[int], None]]:
    """The stream of four deliveries, the users' state, and what adds a delivery's events to it."""
    folder, stream = _deliveries(spark, sf)
    known = state.Snapshots(shared_folder(spark, "state"), "user_id long, n long, total decimal(28,2)")

    def add(number: int) -> None:
        seen = t(spark, sf, "events").where(c("event_id") % 4 == number).groupBy("user_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum(c("value").cast("decimal(18,2)")).alias("total")
        )
        _, was = known.newest(spark)
        both = was.unionByName(seen).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(28,2)").alias("total"))
        known.add(both, number)

    return stream, known, add


@query(f"""WITH s AS ({_STATE}), p AS (SELECT event_id, batch, n = 0 AS cold_card, least(1.0, round(0.002 * value + 0.1 * coalesce(value / nullif(total / n, 0), 0), 9)) AS fraud_probability FROM s)
SELECT *, CASE WHEN fraud_probability >= 0.25 THEN 'review' ELSE 'approve' END AS decision FROM p""")
def stream_state_lookup(spark, sf):
    """Scores with the state of the user as it is when the batch begins; it changes between batches."""
    stream, known, add = _growing_state(spark, sf)
    ratio = F.coalesce(F.try_divide(c("value"), F.try_divide(c("total").cast("double"), c("n"))), F.lit(0.0))
    score = lambda x: x.withColumn("fraud_probability", F.least(F.lit(1.0), F.round(0.002 * c("value") + 0.1 * ratio, 9)))
    out = shared_folder(spark, "looked-up")
    state.state_scoring(stream, known, "user_id", score, 0.25, out, after=add)
    return spark.read.parquet(f"{out}/scored").select("event_id", c("batch").cast("int").alias("batch"), "cold_card", "fraud_probability", "decision")


@query(f"""WITH s AS ({_STATE}) SELECT event_id, batch, n = 0 AS cold_card, CASE WHEN batch < 2 THEN 'v1' ELSE 'v2' END AS model_version, CAST(0.5 AS DOUBLE) AS threshold,
CASE WHEN CASE WHEN batch < 2 THEN event_type = 'purchase' ELSE n = 0 END THEN 'review' ELSE 'approve' END AS decision FROM s""")
def stream_model(spark, sf):
    """Decisions by the model that is current when a batch begins: the first learned to review purchases, the second, which comes after two of four
    batches, events of users without a state. Both are boosted trees over the same two inputs."""
    from cardlake.operators import model as B

    stream, known, add = _growing_state(spark, sf)
    kind, new = (c("event_type") == "purchase").cast("double"), c("cold_card").cast("double")
    inputs = lambda x: x.withColumns({"is_purchase": kind, "is_new": new})
    past = inputs(t(spark, sf, "events").where(c("event_id") % 4 == 3).withColumn("cold_card", c("event_id") % 8 == 3))
    folder, out = shared_folder(spark, "models"), shared_folder(spark, "decided")
    learned = lambda label: B.fit(past.withColumn("label", c(label)), ["is_purchase", "is_new"], maxIter=2, maxDepth=2)
    B.save(learned("is_purchase"), folder, "v1", threshold=0.5)

    def after(number: int) -> None:
        add(number)
        if number == 1:
            B.save(learned("is_new"), folder, "v2", threshold=0.5)

    state.model_scoring(stream, folder, known, "user_id", inputs, out, after=after)
    return spark.read.parquet(f"{out}/scored").select("event_id", c("batch").cast("int").alias("batch"), "cold_card", "model_version", "threshold", "decision")


_RECORD = T.StructType(
    [
        T.StructField("event_id", T.LongType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("value", T.DoubleType(), False),
        T.StructField("props", T.StringType()),
    ]
)


@query("""SELECT CAST(user_id AS VARCHAR) AS key, CASE WHEN event_id % 13 = 4 THEN 'value: is required' WHEN event_id % 13 = 6 THEN 'event_type: is required' WHEN user_id % 50 = 7 THEN 'key: is required' END AS reason,
count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE NOT (event_id % 13 IN (4, 6) OR user_id % 50 = 7) GROUP BY 1, 2
UNION ALL SELECT NULL, CASE WHEN event_id % 13 = 4 THEN 'value: is required' WHEN event_id % 13 = 6 THEN 'event_type: is required' ELSE 'key: is required' END, count(*), CAST(sum(event_id) AS BIGINT)
FROM events WHERE event_id % 13 IN (4, 6) OR user_id % 50 = 7 GROUP BY 1, 2""")
def stream_keyed_sink(spark, sf):
    """Framed records by key through the sink, and read back; rows that can't be encoded are beside them with the reason, and counted by the manifests."""
    _, stream = _deliveries(spark, sf)
    rows = stream.withColumns({
        "value": F.when(c("event_id") % 13 != 4, c("value")),
        "event_type": F.when(c("event_id") % 13 != 6, c("event_type")),
        "user_id": F.when(c("user_id") % 50 != 7, c("user_id")),
    }).drop("ts")
    columns = [c(f.name) for f in _RECORD]
    out, at = shared_folder(spark, "records"), shared_folder(spark, "records-state")
    keyed.write(keyed.keyed(rows, c("user_id"), avro.encode(_RECORD, 7, *columns), avro.unwritable(_RECORD, *columns)), out, at)
    good = keyed.records(spark, out).select("key", avro.decode(_RECORD, c("value"), 7).alias("r"))
    good = good.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("r.event_id").alias("ids"))
    bad = keyed.rejects(spark, out).groupBy("reason").agg(F.sum(F.get_json_object("raw", "$.event_id").cast("bigint")).alias("ids"))
    counts = keyed.manifests(spark, out).select(F.explode("reasons").alias("r")).groupBy("r.reason").agg(F.sum("r.n").alias("n"))
    text = F.lit(None).cast("string")
    return good.select("key", text.alias("reason"), "n", "ids").unionByName(bad.join(counts, "reason").select(text.alias("key"), "reason", "n", "ids"))


@query("""WITH b AS (SELECT event_id % 4 AS batch, count(*) AS n, count(*) FILTER (WHERE event_id % 11 = 5) AS poison FROM events GROUP BY 1)
SELECT CAST(batch AS BIGINT) AS batch, unnest(['input_rows', 'poison', 'scored', 'behind']) AS metric,
CAST(unnest([n, poison, n - poison, sum(n) OVER () - sum(n) OVER (ORDER BY batch)]) AS DOUBLE) AS value FROM b""")
def stream_metrics(spark, sf):
    """What a stream over framed records tells of each batch: rows read, records that couldn't be decoded, rows scored, and rows still to be read."""
    schema = T.StructType([T.StructField("event_id", T.LongType(), False), T.StructField("value", T.DoubleType(), False)])
    e = t(spark, sf, "events").withColumn("v", avro.encode(schema, 7, c("event_id"), c("value")))
    framed = e.select("event_id", "ts", F.when(c("event_id") % 11 == 5, F.substring("v", 1, 9)).otherwise(c("v")).alias("v"))
    folder, stream = _deliveries(spark, sf, rows=framed)
    read = stream.select(avro.decode(schema, c("v"), 7).alias("r")).observe(
        "records", F.count_if(~F.coalesce(c("r.ok"), F.lit(False))).alias("poison"), F.count_if("r.ok").alias("scored")
    )
    told = shared_folder(spark, "told")
    with metrics.recorded(spark, told):
        jobs.run(read.where("r.ok").select("r.event_id", F.least(F.lit(1.0), 0.004 * c("r.value")).alias("score")), "scored")
    rows = spark.read.parquet(told).where(c("metric").isin("input_rows", "poison", "scored"))
    rows = rows.groupBy("batch", "metric").agg(F.sum("value").alias("value"))
    there = spark.read.parquet(folder).count()
    so_far = F.sum("value").over(Window.orderBy("batch"))  # a row for each batch
    behind = rows.where("metric = 'input_rows'").select("batch", F.lit("behind").alias("metric"), (F.lit(float(there)) - so_far).alias("value"))
    return rows.unionByName(behind)


@query("""WITH f AS (SELECT * FROM events ORDER BY ts, event_id LIMIT 400) SELECT event_id, event_type, value FROM f""")
def stream_paced(spark, sf):
    """The first 400 events, replayed in four files, of which one is read every half second."""
    e = t(spark, sf, "events")
    stream = jobs.source(spark, jobs.replay(e, "ts", 4, limit=400, seq="event_id"), e.schema, "ts")
    return jobs.paced(stream, "paced", "500 milliseconds").select("event_id", "event_type", "value")


@query("""WITH b AS (SELECT event_id % 4 AS batch, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(batch AS BIGINT) AS batch, n AS n_rows, CAST(batch AS BIGINT) AS last_offset, CAST(batch < 2 AS BOOLEAN) AS before_restart FROM b""")
def stream_progress(spark, sf):
    """Rows and offsets of each batch of a query that is stopped after two files and goes on with the next two."""
    e, folder, out = t(spark, sf, "events"), shared_folder(spark, "deliveries"), shared_folder(spark, "progress")
    told: list[tuple] = []
    wide = jobs.width(e, 4)
    for half in ((0, 1), (2, 3)):
        for i in half:
            jobs.deliver(e.where(c("event_id") % 4 == i), folder, wide)
        q = jobs.foreach_batch(jobs.source(spark, folder, e.schema, "ts", wide), out, lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/rows/batch={n}"))
        told += [(b, n, int(re.search(r"\d+", end)[0]), half == (0, 1)) for b, _, n, end, _ in jobs.progress(q) if n]
    return spark.createDataFrame(told, "batch long, n_rows long, last_offset long, before_restart boolean")
