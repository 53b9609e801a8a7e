"""From raw rows to contract events, and from events to the columns that a model reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardlake.functions import expr as X
from cardlake.operators import windows as W

# Fixed names of the raw file's columns.
RAW_COLUMNS = [
    "User",
    "Card",
    "Year",
    "Month",
    "Day",
    "Time",
    "Amount",
    "Use Chip",
    "Merchant Name",
    "Merchant City",
    "Merchant State",
    "Zip",
    "MCC",
    "Errors?",
    "Is Fraud?",
]
RAW_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in RAW_COLUMNS])


def _text(name: str) -> Column:
    return F.coalesce(F.trim(F.col(f"`{name}`")), F.lit(""))


def content_id(columns: list[str]) -> Column:
    """An identifier in the form of a UUID from a row's content: the same when a task runs again, or a row is delivered again."""
    digest = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in columns)))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def to_events(raw: DataFrame, salt: str) -> DataFrame:
    """raw's further columns, the contract's sixteen, and reason: why a row can't be an event, or null.

    Times are UTC, written in ISO 8601."""
    channel = X.lookup(X.CHANNELS, _text("Use Chip"), "online")
    state, errors = _text("Merchant State"), F.rtrim(_text("Errors?"), F.lit(","))
    time = X.event_time(_text("Year"), _text("Month"), _text("Day"), _text("Time"))
    amount, mcc = X.money(_text("Amount")), _text("MCC").try_cast("int")
    reason = F.when(time.isNull(), "Time: is no time").when(amount.isNull(), "Amount: is no number").when(mcc.isNull(), "MCC: is no integer")
    reason = reason.when(~mcc.between(0, 9999), "MCC: must be from 0 to 9999")
    own = [c for c in raw.columns if c not in RAW_COLUMNS]
    return raw.select(
        *own,
        F.lit("1.0.0").alias("schema_version"),
        content_id(RAW_COLUMNS).alias("event_id"),
        X.iso(time).alias("event_time"),
        X.token(salt, _text("User"), _text("Card")).alias("card_token"),
        _text("User").alias("user_id"),
        amount.alias("amount"),
        F.lit("USD").alias("currency"),
        channel.alias("channel"),
        _text("Merchant Name").alias("merchant_name"),
        _text("Merchant City").alias("merchant_city"),
        F.when(channel == "online", "ONLINE").when(state == "", "XX").otherwise(state).alias("merchant_state"),
        X.country(channel, state).alias("merchant_country"),
        mcc.alias("mcc"),
        X.zip_code(F.col("Zip")).alias("zip"),
        F.when(errors != "", errors).alias("errors"),
        X.yes_no(F.col("`Is Fraud?`")).alias("is_fraud"),
        reason.alias("reason"),
    )


def dead_letters(raw: DataFrame, reason: Column, columns: list[str]) -> DataFrame:
    """A line of JSON {raw, error} for each row with a reason."""
    rows = raw.withColumn("__reason", reason).where(F.col("__reason").isNotNull())
    return rows.select(
        F.to_json(F.struct(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("raw"), F.col("__reason").alias("error"))).alias("value")
    )


def enriched(events: DataFrame, time: str = "event_time") -> DataFrame:
    """events and what can be said of each by itself. time is a timestamp, or text in ISO 8601."""
    at = F.col(time) if dict(events.dtypes)[time] != "string" else X.parse_iso(F.col(time))
    channel = F.col("channel")
    return events.withColumns(
        {
            "is_cnp": F.coalesce(channel == "online", F.lit(False)),
            "is_chip": F.coalesce(channel == "chip", F.lit(False)),
            "is_swipe": F.coalesce(channel == "swipe", F.lit(False)),
            "is_cross_border": X.cross_border(F.col("merchant_country")),
            "mcc_group": X.mcc_group(F.col("mcc")),
            "mcc_group_id": X.mcc_group_id(F.col("mcc")),
            "has_error": F.coalesce(F.col("errors") != "", F.lit(False)),
            "amount_log": F.log1p(F.abs("amount")),
            "hour_of_day": F.hour(at),
            "day_of_week": F.weekday(at),
        }
    )


def channel_of(cnp: Column, chip: Column) -> Column:
    """The channel that its indicators stand for."""
    return F.when(cnp, "online").when(chip, "chip").otherwise("swipe")


# Fixed names of what a model reads, in order: EVENT_FEATURES, HISTORY_FEATURES, and WINDOW_FEATURES of each window.
EVENT_FEATURES = [
    "amount",
    "amount_log",
    "is_cnp",
    "is_chip",
    "is_swipe",
    "is_cross_border",
    "mcc_group_id",
    "mcc",
    "has_error",
    "hour_of_day",
    "day_of_week",
]
HISTORY_FEATURES = ["time_since_last_txn_s", "is_new_city_30d", "amount_over_mean_30d"]
WINDOW_FEATURES = ["txn_count", "amount_sum", "amount_mean", "distinct_merchant_city", "decline_rate"]
#: The columns that a model reads, in order.
FEATURES = [*EVENT_FEATURES, *HISTORY_FEATURES, *(f"{m}_{w}" for w in W.WINDOWS for m in WINDOW_FEATURES)]


def feature_rows(events: DataFrame, key: str, time: str, seq: str, keep: list[str]) -> DataFrame:
    """keep and FEATURES (numbers) of each event: its own columns (amount, channel, merchant_country, merchant_city, mcc, errors) and its key's history.

    A first event is as long after the last one as CAP says, and its city counts as new."""
    rows = enriched(events, time)
    rows = W.since_last(rows, key, time, seq)
    rows = W.trailing(rows, key, time, seq, "amount", F.col("has_error"), "merchant_city")
    mean = F.col("amount_mean_30d")
    more = {"amount_over_mean_30d": F.col("amount") / F.when(mean == 0, 1.0).otherwise(mean)}
    more["is_new_city_30d"] = F.coalesce(F.col("is_new_city_30d"), F.lit(True)).cast("int")
    more |= {c: F.col(c).cast("int") for c in EVENT_FEATURES if c.startswith("is_") or c == "has_error"}
    rows = rows.withColumns(more).withColumnsRenamed({f"distinct_city_{w}": f"distinct_merchant_city_{w}" for w in W.WINDOWS})
    return rows.select(*keep, *FEATURES)


def online_row(stored: DataFrame) -> DataFrame:
    """FEATURES as doubles with 0 for windows that are not known, as for a card without a history."""
    have = set(stored.columns)
    return stored.select(
        *(c for c in stored.columns if c not in FEATURES),
        *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c) for c in FEATURES),
    )


# Fixed columns of the stored tables.
TRANSACTION_ROW = "event_id schema_version card_token user_id event_time amount currency channel merchant_name merchant_city merchant_state merchant_country zip mcc errors is_fraud".split()
SCORED_ROW = "event_id card_token event_time amount merchant_name merchant_city merchant_state mcc channel fraud_probability decision cold_card latency_ms".split()
ALERT_ROW = "event_id card_token fraud_probability amount merchant_name".split()


def _stored(events: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, null where events lack one; event_time as a timestamp."""
    have = set(events.columns)
    at = X.parse_iso(F.col("event_time")) if dict(events.dtypes).get("event_time") == "string" else F.col("event_time")
    return events.select(*((at if c == "event_time" else F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in columns))


def transaction_rows(events: DataFrame) -> DataFrame:
    """Contract events as rows of the table of transactions."""
    return _stored(events, TRANSACTION_ROW)


def scored_rows(scored: DataFrame) -> DataFrame:
    """Events with fraud_probability and decision (and cold_card, latency_ms) as rows of the table of scores; a card isn't cold unless that is said."""
    have = set(scored.columns)
    cold = F.coalesce(F.col("cold_card"), F.lit(False)) if "cold_card" in have else F.lit(False)
    latency = F.col("latency_ms").cast("double") if "latency_ms" in have else F.lit(None).cast("double")
    return _stored(scored.withColumns({"cold_card": cold, "latency_ms": latency}), SCORED_ROW)


def alert_rows(scored: DataFrame, threshold: float | None = None) -> DataFrame:
    """Rows of the table of alerts: events at or above a threshold, or the one that each was scored by (1 where there is none)."""
    own = F.coalesce(F.col("threshold"), F.lit(1.0)) if "threshold" in scored.columns else F.lit(1.0)
    return _stored(scored.where(F.col("fraud_probability") >= (own if threshold is None else F.lit(threshold))), ALERT_ROW)
