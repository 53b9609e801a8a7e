"""Boosted trees with class weights: chosen among settings on validation rows, kept as versions with a manifest and a pointer to the current one."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.operators import metrics as M

#: Settings that are tried in turn; the next one only while the best is poorer than ENOUGH.
SETTINGS = [{"maxDepth": 4, "stepSize": 0.1, "maxIter": 20}, {"maxDepth": 6, "stepSize": 0.05, "maxIter": 40}]
ENOUGH = 0.05
CURRENT = "current"


def fit(rows: DataFrame, features: list[str], label: str = "label", validation: str | None = None, **settings: object) -> PipelineModel:
    """Positive rows weigh as much as all negative ones together. Rows that validation (a boolean column) marks
    aren't learned from: no more trees are added once they no longer help there. Null features count as 0."""
    own = rows.where(~F.col(validation)) if validation else rows
    n = own.agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("all")).first()
    weight = (n["all"] - n["pos"]) / n["pos"] if n["pos"] else 1.0
    rows = rows.withColumn("weight", F.when(F.col(label) == 1, float(weight)).otherwise(1.0)).fillna(0.0, features)
    more = {"validationIndicatorCol": validation, "validationTol": 0.001} if validation else {}
    trees = GBTClassifier(labelCol=label, weightCol="weight", seed=42, **({"maxIter": 5, "maxDepth": 4} | settings | more))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), trees]).fit(rows)


def features_of(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with probability. Null features count as 0; other columns stay as they are."""
    names = features_of(model)
    filled = rows.withColumns({f"__{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names})
    take = VectorAssembler(inputCols=[f"__{c}" for c in names], outputCol="features")
    out = model.stages[-1].transform(take.transform(filled))
    return out.withColumn("probability", vector_to_array("probability")[1]).select(*rows.columns, "probability")


def expression(model: PipelineModel) -> str:
    """The model's probability in SQL, read from its printed trees: what any engine computes from the columns of its features. Null features count as 0."""
    names, trees = features_of(model), model.stages[-1]

    def tree(lines: list[str]) -> str:
        head = lines.pop(0).strip()
        if head.startswith("Predict:"):
            return f"CAST({head.removeprefix('Predict:').strip()} AS DOUBLE)"
        feature, limit = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", head).groups()
        low = tree(lines)
        if not lines.pop(0).strip().startswith("Else"):
            raise ValueError("a branch has no other side")
        return f"CASE WHEN coalesce(CAST({names[int(feature)]} AS DOUBLE), 0) <= CAST({limit} AS DOUBLE) THEN {low} ELSE {tree(lines)} END"

    parts = [f"CAST({w} AS DOUBLE) * ({tree(t.toDebugString.strip().splitlines()[1:])})" for t, w in zip(trees.trees, trees.treeWeights, strict=True)]
    return f"1 / (1 + exp(-2 * ({' + '.join(parts)})))"


def evaluated(model: PipelineModel, rows: DataFrame, label: str, threshold: float | None = None) -> dict[str, object]:
    """Average precision, ROC-AUC, and precision, recall, F1 and counts at a threshold (the one of greatest F1, if none is given)."""
    done = scored(model, rows).select("probability", F.col(label).cast("int").alias("y"))
    points = M.curve(done, "probability", "y")
    out = {"pr_auc": M.average_precision(points).first()[0] or 0.0, "roc_auc": M.roc_auc(points).first()[0]}
    if threshold is None:
        best = M.best_threshold(points).first()
        threshold = best["threshold"] if best and best["f1"] is not None else 1.0
    counts = M.confusion(done, "probability", "y", threshold).first().asDict()
    return out | {"threshold": threshold} | counts


def choose(rows: DataFrame, features: list[str], label: str, split: str, settings: list[dict[str, object]] = SETTINGS) -> tuple[PipelineModel, dict[str, object], list[dict[str, object]]]:
    """The model of best average precision on the validation rows, its figures on the test rows at the validation rows' threshold, and what was tried.

    split says of each row whether it is train, validation or test; test rows decide nothing."""
    known = rows.where(F.col(split).isin("train", "validation")).withColumn("__validation", F.col(split) == "validation")
    valid, test = (rows.where(F.col(split) == x) for x in ("validation", "test"))
    tried: list[tuple[float, PipelineModel, dict[str, object]]] = []
    for s in settings:
        if tried and max(x[0] for x in tried) >= ENOUGH:
            break
        model = fit(known, features, label, "__validation", **s)
        on_valid = evaluated(model, valid, label)
        tried.append((on_valid["pr_auc"], model, {"settings": s, "trees": model.stages[-1].getNumTrees, "validation": on_valid}))
    _, model, told = max(tried, key=lambda x: x[0])
    return model, evaluated(model, test, label, told["validation"]["threshold"]), [x[2] for x in tried]


def run_id(now: datetime, revision: str) -> str:
    """Ascends with time."""
    return f"{now.astimezone(timezone.utc):%Y%m%dT%H%M%SZ}-{revision}"


def _write_json(spark: SparkSession, path: str, told: dict[str, object]) -> None:
    spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> dict[str, object] | None:
    try:
        return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
    except (AnalysisException, ValueError):
        return None


def make_current(spark: SparkSession, folder: str, version: str) -> None:
    """Makes a version the current one."""
    _write_json(spark, f"{folder}/{CURRENT}", {"version": version})


def save(model: PipelineModel, folder: str, version: str, *, point: bool = True, **facts: object) -> None:
    """The model and its manifest; the pointer, unless it is to stay, is written last, so a reader sees whole versions only."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{folder}/{version}/model")
    _write_json(spark, f"{folder}/{version}/manifest", {"version": version, "features": features_of(model), **facts})
    if point:
        make_current(spark, folder, version)


def load(spark: SparkSession, folder: str, version: str) -> tuple[PipelineModel, dict[str, object]]:
    """A version's model and its manifest."""
    manifest = _read_json(spark, f"{folder}/{version}/manifest")
    if not manifest:
        raise FileNotFoundError(f"{folder} has no version {version}")
    return PipelineModel.load(f"{folder}/{version}/model"), manifest


def load_current(spark: SparkSession, folder: str, fallback: str | None = None) -> tuple[PipelineModel, dict[str, object]]:
    """The current model and its manifest. Without a pointer, or with one to a version that isn't there, the fallback version."""
    told = _read_json(spark, f"{folder}/{CURRENT}")
    for version in (told and told.get("version"), fallback):
        manifest = version and _read_json(spark, f"{folder}/{version}/manifest")
        if manifest:
            return load(spark, folder, version)
    raise FileNotFoundError(f"{folder} has no current model")
