"""Tables in a catalog and keyed snapshots on files: guarded definitions, reads that don't fail, appends of new rows, upserts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardlake.functions import events as E


def create_missing(spark: SparkSession, tables: dict[str, T.StructType], database: str = "default") -> list[str]:
    """Defines those tables that aren't there yet as Parquet tables; returns their names. Keys and rules are checks (see ``violations``), not part of a table."""
    made = []
    for name, schema in tables.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            spark.createDataFrame([], schema).write.mode("ignore").format("parquet").saveAsTable(f"{database}.{name}")
            made.append(name)
    return made


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The files' rows, or none with the same columns if there is nothing to read."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def load_events(spark: SparkSession, path: str, schema: T.StructType, salt: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Contract events of a CSV file's rows of some years, and the reason of those that are skipped. Rows outside the years aren't rows of the result;
    those without a year are skipped for that if there are limits."""
    raw = spark.read.schema(schema).option("header", True).option("nullValue", "\\N").option("emptyValue", "").csv(path)
    raw = raw.fillna("", E.RAW_COLUMNS)
    if since is None and until is None:
        return E.to_events(raw, salt)
    year = F.trim("Year").try_cast("int")
    inside = (year >= (since if since is not None else year)) & (year <= (until if until is not None else year))
    rows = raw.where(year.isNull() | inside).withColumn("__no_year", year.isNull())
    events = E.to_events(rows, salt)
    reason = F.when(F.col("__no_year"), "Year: is no year").otherwise(F.col("reason"))
    return events.withColumn("reason", reason).drop("__no_year")


def append_new(rows: DataFrame, path: str, key: str, by: str | None = None) -> None:
    """Adds the rows whose key isn't stored, each once.

    by names a column whose value is the same in all copies of a row, such as its day: the table is partitioned by it, and of what is stored only
    partitions from the least to the greatest value among the rows are read."""
    stored = read_or_empty(rows.sparkSession, path, rows.schema)
    if by:
        lo, hi = rows.agg(F.min(by), F.max(by)).first()
        stored = stored.where(F.col(by).between(F.lit(lo), F.lit(hi)) | F.col(by).isNull())
    new = rows.dropDuplicates([key]).join(stored.select(key), key, "left_anti").write.mode("append")
    (new.partitionBy(by) if by else new).parquet(path)


def upserted(stored: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of greatest order of each key: of equal ones a new row wins. A snapshot to be written to a place of its own."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    whole = F.struct(*(F.col(c) for c in stored.columns))
    last = both.groupBy(key).agg(F.max_by(whole, F.struct(order, "__new")).alias("row"))
    return last.select("row.*")


def updated(rows: DataFrame, column: str, value: str, where: Column) -> DataFrame:
    """rows with a new value where a condition holds; null conditions don't."""
    return rows.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def violations(rows: DataFrame, *, unique: list[str] = (), required: list[str] = (), accepted: dict[str, list[str]] | None = None, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """(check, violations) of keys, required columns, accepted values, and references (a column and its parents' keys, in the first column)."""
    out = None
    checks = [(f"{c}_null", rows.agg(F.count_if(F.col(c).isNull()).alias("n"))) for c in required]
    checks += [(f"{c}_unique", rows.groupBy(c).count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))) for c in unique]
    checks += [(f"{c}_accepted", rows.agg(F.count_if(~F.col(c).isin(v)).alias("n"))) for c, v in (accepted or {}).items()]
    checks += [(f"orphan_{c}", rows.where(F.col(c).isNotNull()).join(p.select(F.col(p.columns[0]).alias(c)), c, "left_anti").agg(F.count(F.lit(1)).alias("n"))) for c, p in (parents or {}).items()]
    for name, n in checks:
        row = n.select(F.lit(name).alias("check"), F.col("n").alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out


def counted(rows: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """rows, and counts of conditions among them that are known once they have been read: no pass of their own."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(k) for k, c in conditions.items())), seen


def first_rows(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The n first rows of each key."""
    return rows.withColumn(
        "__place", F.row_number().over(Window.partitionBy(key).orderBy(*order))
    ).where(F.col("__place") <= n).drop("__place")


def samples(lines: DataFrame) -> DataFrame:
    """metric, labels (a map) and value of lines in the Prometheus text format; comments and what isn't a sample are left out. +Inf counts as infinity."""
    part = lambda i: F.regexp_extract("value", r'^([A-Za-z_:][\w:]*)(?:\{(.*)\})?\s+(\S+)', i)
    pairs = F.regexp_extract_all(part(2), F.lit(r'(\w+)="([^"]*)"'), F.lit(0))
    labels = F.map_from_entries(
        F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r'^(\w+)=', 1), F.regexp_extract(p, r'"(.*)"$', 1)))
    )
    number = F.when(part(3) == "+Inf", float("inf")).otherwise(part(3).try_cast("double"))
    return lines.where(~F.col("value").startswith("#")).select(
        part(1).alias("metric"), labels.alias("labels"), number.alias("value")
    ).where((F.col("metric") != "") & F.col("value").isNotNull())
