"""State that one job writes and another looks up: numbered snapshots, scores that join them, and models that are swapped while a stream runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cardlake.operators import model as B
from cardlake.sources import tables
from cardlake.streaming import jobs

LOG = "number long, path string"


class Snapshots:
    """Whole states of a keyed table. A snapshot is written to a place of its own and then named in a log, which is only appended to: readers see whole ones."""

    def __init__(self, folder: str, schema: T.StructType | str):
        self.folder, self.schema = folder, schema

    def newest(self, spark: SparkSession, below: int | None = None) -> tuple[int, DataFrame]:
        """The number and rows of the last snapshot (of a number below one, if given); -1 and none before the first."""
        log = tables.read_or_empty(spark, f"{self.folder}/log", T.StructType.fromDDL(LOG))
        if below is not None:
            log = log.where(F.col("number") < below)
        last = log.agg(F.max("number").alias("n"), F.max_by("path", F.struct("number", "path")).alias("path")).first()
        if last["n"] is None:
            return -1, spark.createDataFrame([], self.schema)
        return last["n"], spark.read.schema(self.schema).parquet(last["path"])

    def add(self, rows: DataFrame, number: int) -> None:
        path = f"{self.folder}/{number:06d}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        rows.sparkSession.createDataFrame([(number, path)], LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")


def with_state(rows: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """rows with the state of their key (null where there is none) and cold_card: that there is none."""
    known = state.withColumn("__known", F.lit(True))
    return rows.join(known, key, "left").withColumn("cold_card", F.col("__known").isNull()).drop("__known")


def state_scoring(e: DataFrame, snapshots: Snapshots, key: str, score: Callable[[DataFrame], DataFrame], threshold: float, out: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Scores each event with its key's state, which is looked up anew for each batch; score adds fraud_probability to events with state and cold_card.

    To out/scored. A batch that runs again sees the snapshot that it saw first. after is called when a batch is done."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        number_of_state = _pinned(spark, f"{out}/seen/batch={number}", lambda: snapshots.newest(spark)[0])
        _, state = snapshots.newest(spark, number_of_state + 1)
        scored = score(with_state(rows, state, key))
        decided = scored.withColumn("decision", F.when(F.col("fraud_probability") >= threshold, "review").otherwise("approve"))
        decided.write.mode("overwrite").parquet(f"{out}/scored/batch={number}")
        if after:
            after(number)

    with jobs.rocks(e.sparkSession):
        return jobs.foreach_batch(jobs.first_deliveries(e.where(F.col("event_id").isNotNull()), "event_id", F.lit(True)).drop("ok"), out, batch)


def model_scoring(e: DataFrame, models: str, snapshots: Snapshots, key: str, features: Callable[[DataFrame], DataFrame], out: str, *, fallback: str | None = None, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Scores each event by the model that is current when its batch begins: a new version takes over without a restart.

    features adds a model's inputs to events with state and cold_card. To out/scored: the event with fraud_probability, decision (by the
    manifest's threshold), threshold, cold_card and model_version. A batch that runs again takes the model and the snapshot that it took first."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        version = _pinned(spark, f"{out}/model/batch={number}", lambda: B.load_current(spark, models, fallback)[1]["version"])
        number_of_state = _pinned(spark, f"{out}/seen/batch={number}", lambda: snapshots.newest(spark)[0])
        model, manifest = B.load(spark, models, version)
        _, state = snapshots.newest(spark, number_of_state + 1)
        x = features(with_state(rows, state, key))
        threshold = float(manifest.get("threshold", 0.5))
        scored = B.scored(model, x).withColumnRenamed("probability", "fraud_probability").select(*rows.columns, "cold_card", "fraud_probability")
        decided = scored.withColumns({
            "decision": F.when(F.col("fraud_probability") >= threshold, "review").otherwise("approve"),
            "threshold": F.lit(threshold),
            "model_version": F.lit(version),
        })
        decided.write.mode("overwrite").parquet(f"{out}/scored/batch={number}")
        if after:
            after(number)

    with jobs.rocks(e.sparkSession):
        return jobs.foreach_batch(jobs.first_deliveries(e.where(F.col("event_id").isNotNull()), "event_id", F.lit(True)).drop("ok"), out, batch)


def _pinned(spark: SparkSession, path: str, now: Callable[[], object]) -> object:
    """What a batch saw when it ran first: now's value is kept, as text or a number, and read if the batch runs again."""
    value = now()
    kind = "long" if isinstance(value, int) else "string"
    kept = tables.read_or_empty(spark, path, T.StructType.fromDDL(f"value {kind}")).first()
    if kept is not None:
        return kept["value"]
    spark.createDataFrame([(value,)], f"value {kind}").coalesce(1).write.mode("overwrite").parquet(path)
    return value
