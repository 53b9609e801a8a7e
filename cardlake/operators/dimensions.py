"""Customers, accounts and cards, derived from the users and cards that a file names: the same ones each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlake.functions import expr as X
from cardlake.operators.ordered import in_ranges, running

# Fixed values of the derived rows.
KINDS = ["credit", "debit", "prepaid"]
SINCE = "2010-01-01"


def _number(text: Column) -> Column:
    """A number that is written in decimal, or one from the hash of another text."""
    return F.coalesce(text.try_cast("bigint"), F.pmod(F.xxhash64(text), F.lit(1_000_003)))


def placed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows and place, from 1, in the order of each column's length and then its text: 9 comes before 10. By ranges of the first column's number and length, without one task for all."""
    by = [x for c in columns for x in (F.length(c), F.col(c))]
    raw = F.rpad(F.hex(F.col(columns[0]).cast("binary")), 16, "0")  # 8 bytes, as two numbers
    number = lambda at, size: F.coalesce(F.conv(F.substring(raw, at, size), 16, 10).cast("double"), F.lit(0.0))
    first = F.length(columns[0]).cast("double") * 1e6 + number(1, 4)
    ranged = in_ranges(rows.withColumns({"__first": first, "__next": number(5, 12), "__one": F.lit(1).cast("long")}), "__first", tie=F.col("__next"))
    out = running(ranged, [], by, {"__one": "__before"})
    return out.withColumn("place", F.coalesce("__before", F.lit(0)) + 1).drop("__first", "__next", "__one", "__before", "__range")


def dimensions(pairs: DataFrame, salt: str) -> dict[str, DataFrame]:
    """pairs: User, Card. Three tables (id, parent, detail, amount, since, place), each after the one that it refers to."""
    pairs = pairs.select(F.trim("User").alias("User"), F.trim("Card").alias("Card")).distinct()
    users = placed(pairs.select("User").distinct(), ["User"])
    cards = placed(pairs, ["User", "Card"])
    day, none = F.lit(SINCE).cast("date"), F.lit(None)
    account = F.concat(F.lit("acct-"), F.col("User"))
    number = _number(F.col("Card"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(number, F.lit(len(KINDS))) + 1).cast("int"))
    limit = (1000 * (1 + F.pmod(_number(F.col("User")), F.lit(20)))).cast("double")
    table = lambda rows, id_, parent, detail, amount, since: rows.select(id_.alias("id"), parent.cast("string").alias("parent"), detail.alias("detail"), amount.cast("double").alias("amount"), since.cast("timestamp_ntz").alias("since"), F.col("place").cast("bigint").alias("place"))
    return {
        "customer": table(users, F.col("User"), none, F.lit("standard"), none, day),
        "account": table(users, account, F.col("User"), F.lit("active"), limit, day),
        "card": table(cards, X.token(salt, F.col("User"), F.col("Card")), account, kind, none, F.date_add(day, number.cast("int"))),
    }
