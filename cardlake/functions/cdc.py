"""Change data capture: rows of a change table to envelopes, envelopes to contract events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlake.functions import expr as X

# Fixed codes of a change table's operations.
OPERATIONS = {1: "d", 2: "c", 4: "u"}
META = ["__$start_lsn", "__$end_lsn", "__$seqval", "__$operation", "__$update_mask"]
# Every field is read as its JSON text, so that a wrong kind is noticed and not lost.
FIELDS = "schema_version event_id event_time card_token user_id amount currency channel merchant_name merchant_city merchant_state merchant_country zip mcc errors is_fraud".split()
ENVELOPE = f"after struct<{', '.join(f'{f} string' for f in FIELDS)}>, op string, source struct<lsn string>"


def next_lsn(lsn: Column) -> Column:
    """A big-endian binary number of any length plus one; null if it is the greatest. In hexadecimal: the last digit that isn't f goes up, the f after it become 0."""
    digits = F.lower(F.hex(lsn))
    full = F.length(F.regexp_extract(digits, "f*$", 0))
    head = F.substr(digits, F.lit(1), F.length(digits) - full)
    up = F.concat(
        F.substr(head, F.lit(1), F.length(head) - 1),
        F.translate(F.right(head, F.lit(1)), "0123456789abcde", "123456789abcdef"),
        F.repeat(F.lit("0"), full),
    )
    return F.when(F.length(head) > 0, F.unhex(up))


def changes(table: DataFrame, after: bytes, to: bytes) -> DataFrame:
    """A change table's rows above one version and up to another, in the order of (version, sequence)."""
    lsn = F.col("`__$start_lsn`")
    return table.where((lsn > F.lit(after)) & (lsn <= F.lit(to))).orderBy(lsn, F.col("`__$seqval`"))


def envelopes(table: DataFrame, at: Column) -> DataFrame:
    """value: the JSON of each change, without the table's own columns; deletes have no after, and other operations no envelope."""
    kinds = dict(table.dtypes)
    json = lambda c: F.unix_millis(F.col(f"`{c}`").cast("timestamp")) if kinds[c].startswith("timestamp") else F.col(f"`{c}`").cast("double") if kinds[c].startswith("decimal") else F.col(f"`{c}`")
    op = F.element_at(F.create_map(*(F.lit(x) for kv in OPERATIONS.items() for x in kv)), F.col("`__$operation`"))
    after = F.struct(*(json(c).alias(c) for c in table.columns if c not in META))
    rows = table.withColumn("__op", op).where(F.col("__op").isNotNull())
    source = F.struct(F.lower(F.hex("`__$start_lsn`")).alias("lsn"))
    value = F.struct(
        F.lit(None).cast("string").alias("before"),
        F.when(F.col("__op") != "d", after).alias("after"),
        F.col("__op").alias("op"),
        F.unix_millis(at).alias("ts_ms"),
        source.alias("source"),
    )
    return rows.select(F.to_json(value, {"ignoreNullFields": "false"}).alias("value"))


def truth(text: Column) -> Column:
    """true, false, 1 or 0 as JSON text; null for others."""
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def to_events(wire: DataFrame) -> DataFrame:
    """wire's columns but value, lsn (the change's version), the contract's sixteen, and reason. Updates, deletes and null values (tombstones) give no row.

    The JSON is made and parsed once: a generator keeps the parsed value from being copied into each column, and what value is computed from
    from being computed again for the tombstones."""
    own = [c for c in wire.columns if c != "value"]
    once = F.struct(F.col("value").isNull().alias("tombstone"), F.from_json("value", ENVELOPE).alias("v"))
    parsed = wire.select(*own, F.explode(F.array(once)).alias("__once")).where("NOT __once.tombstone")
    parsed = parsed.select(*own, "__once.v.op", "__once.v.after", *([] if "lsn" in own else ["__once.v.source.lsn"]))
    own += [c for c in ("lsn",) if c not in own]
    parsed = parsed.where(F.col("op").isNull() | ~F.col("op").isin("u", "d"))
    a = lambda f: F.col(f"after.{f}")
    time, amount, fraud = a("event_time").try_cast("bigint"), a("amount").try_cast("double"), truth(a("is_fraud"))
    mcc = a("mcc").try_cast("int")
    known = ("schema_version", "event_id", "user_id", "channel", "card_token", "currency")
    reason = F.when(
        ~F.coalesce(F.col("op").isin("c", "r"), F.lit(False)), F.concat(F.lit("unsupported op: "), F.coalesce("op", F.lit("null")))
    )
    reason = reason.when(F.col("after").isNull(), "missing 'after' payload")
    for f in known:
        reason = reason.when(a(f).isNull(), f"mapping error: {f}")
    reason = reason.when(time.isNull(), "mapping error: event_time").when(amount.isNull(), "mapping error: amount")
    reason = reason.when(a("is_fraud").isNotNull() & fraud.isNull(), F.concat(F.lit("unexpected is_fraud value: "), a("is_fraud")))
    plain = {f: a(f) for f in FIELDS} | {f: F.trim(a(f)) for f in ("card_token", "currency", "merchant_country")}
    plain |= {"event_time": X.iso(F.timestamp_millis(time), millis=True), "amount": amount, "mcc": mcc, "is_fraud": fraud}
    parsed = parsed.withColumn("reason", reason)
    return parsed.select(*own, *(F.when(F.col("reason").isNull(), v).alias(f) for f, v in plain.items()), "reason")
