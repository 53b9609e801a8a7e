"""Toxicity by multiple-instance learning.

Documents have labels, sentences don't. A sentence's probability is a logistic function of its features (words and their
first four, five and six bytes, lower case, hashed), a document's the noisy-or of its sentences': one offending sentence is
enough. Both are fitted together from document labels, by gradient steps on the documents' likelihood; afterwards the
sentences with high probabilities are the offending ones.

Fitted on at most SAMPLE labelled documents of each class (those of the least hashes of doc_id), as far as they fit in SAMPLE_BYTES, with the
FEATURES that tell the classes apart best. Documents of over a sixteenth of SAMPLE_BYTES are taken last. Of rows that share a doc_id one is learned
from, that of the least hash of its text. Whole texts are read, in tasks, and only counts and the chosen features' places come to the driver: a
bounded number, however long the texts and however often an id is repeated.
Without labels of both classes all scores are 0.

Null and empty texts score 0. Rows that repeat a doc_id are each scored; a document with several labels counts as toxic if one is.
Null labels are ignored; a null doc_id is not held out and has no label. Other columns pass through, except those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import partitions, table

SAMPLE = 2000
#: Bytes of the texts of a class that are learned from.
SAMPLE_BYTES = 32 << 20
FEATURES = 2048
THRESHOLD = 0.7
#: A sentence without features that tell: so unlikely that thousands of them stay below any threshold.
BIAS = -12.0
PREFIXES = (4, 5, 6)
ENDS = np.zeros(256, dtype=bool)
ENDS[[ord(c) for c in ".!?\n"]] = True


def word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (a column for each kind) of all words, each word's sentence (counted through the batch), rows' first words and first sentences."""
    data, offs = K.text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    start, end, first = K.word_spans(data, offs, K.PLAIN)
    stops = np.unique(np.concatenate([np.flatnonzero(ENDS[data]), offs[1:] - 1]))
    out = np.empty((len(start), 1 + len(PREFIXES)), dtype=np.uint64)
    out[:, 0] = K.span_hashes(data, start, end)
    for i, n in enumerate(PREFIXES):
        h = K.span_hashes(data, start, np.minimum(start + n, end))
        out[:, i + 1] = np.where(end - start > n, K.mix(h + np.uint64(n)), 0)
    return out, np.searchsorted(stops, start), first, np.searchsorted(stops, offs)


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """The distinct rows of these columns, in order."""
    x = np.stack([c.astype(np.int64) for c in columns])
    x = x[:, np.lexsort(x[::-1])]
    keep = np.ones(x.shape[1], dtype=bool)
    keep[1:] = (x[:, 1:] != x[:, :-1]).any(axis=0)
    return x[:, keep]


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in x of the model's features, and which they are."""
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.zeros(1 << 20, dtype=bool)
        near[self.features >> np.uint64(44)] = True
        at = np.flatnonzero(near[x >> np.uint64(44)])
        i = np.minimum(np.searchsorted(self.features, x[at]), len(self.features) - 1)
        ok = self.features[i] == x[at]
        return at[ok], i[ok]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in K.small(batches):
        x, _, first, _ = word_features(b.column("text"))
        y = b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(b.num_rows), np.diff(first))
        for c in range(x.shape[1]):
            f, at = np.unique(x[:, c], return_inverse=True)
            at, of = _distinct(at, row)
            toxic = np.bincount(at, y[of], len(f)).astype(np.int64)
            count = np.bincount(at, minlength=len(f))
            some = f != 0  # words shorter than a prefix
            yield pa.record_batch([K.signed(f[some]), toxic[some], (count - toxic)[some]], names=["feature", "toxic", "clean"])


def _sampled(docs: DataFrame, labels: DataFrame, sample: int, sample_bytes: int) -> DataFrame:
    """doc_id, text and toxic of the documents to learn from. They are written once, so all documents are read once."""
    known = labels.where(
        F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()
    ).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    # at most 2 * sample rows, so small enough for every task
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text"))).alias("one")  # tasks keep one row of an id each
    rows = rows.groupBy("doc_id", "toxic").agg(least).select("doc_id", F.col("one.text").alias("text"), "toxic")
    rows = table(rows.repartition(partitions(docs)), "sample")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sizes = rows.select(F.col("doc_id").alias("id"), F.col("toxic").alias("class"), size.alias("size"))  # at most 2 * sample rows
    order = Window.partitionBy("class").orderBy(F.col("size") > sample_bytes // 16, F.xxhash64("id"), "id")
    fit_in = sizes.withColumn("total", F.sum("size").over(order)).where(F.col("total") <= sample_bytes).select("id")
    return rows.join(F.broadcast(fit_in), F.col("doc_id") == F.col("id"), "left_semi")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic; those held out are not read."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0))
    rows = _sampled(docs, labels, sample, sample_bytes)
    counts = rows.mapInArrow(_counts, "feature long, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    # how far the classes' shares differ, in their standard errors
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5))
    best = counts.where("toxic + clean >= 3").select(
        "feature", (odds * F.sqrt(F.greatest("toxic", "clean"))).alias("gain")
    ).where("gain > 0").orderBy(F.desc("gain"), "feature").limit(features)
    found = np.sort(np.array([r.feature for r in best.collect()], dtype=np.int64).view(np.uint64))
    if not len(found):
        return none
    model = Model(found, np.zeros(len(found)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.small(batches):
            x, sentence, first, base = word_features(b.column("text"))
            at, which = model.find(x.ravel())
            word = at // x.shape[1]
            row = np.searchsorted(first, word, side="right") - 1
            cells = _distinct(row, sentence[word] - base[row], which)
            hit = np.bincount(cells[0], minlength=b.num_rows)
            lone = np.flatnonzero(hit == 0)  # documents without any chosen feature count too
            row = np.concatenate([cells[0], lone])
            pad = np.full(len(lone), -1)
            ids, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "toxic"))
            yield pa.record_batch(
                [
                    ids[row].astype(np.int64),
                    y[row].astype(np.int32),
                    np.concatenate([cells[1], pad]).astype(np.int32),
                    np.concatenate([cells[2], pad]).astype(np.int32),
                ],
                names=["doc", "toxic", "sentence", "which"],
            )

    cells = rows.mapInArrow(places, "doc long, toxic int, sentence int, which int").toPandas()
    if cells.toxic.nunique() < 2:
        return none
    model.weights = _train(cells.doc.to_numpy(), cells.toxic.to_numpy(), cells.sentence.to_numpy(), cells.which.to_numpy(), len(found))
    return model


def _train(doc: np.ndarray, toxic: np.ndarray, sentence: np.ndarray, which: np.ndarray, n: int, steps: int = 600) -> np.ndarray:
    """Weights that make the labels likely (Adam, with a small penalty on squares)."""
    docs, d = np.unique(doc, return_inverse=True)
    y = np.zeros(len(docs))
    np.maximum.at(y, d, toxic)
    ok = which >= 0
    key, s = np.unique(d[ok].astype(np.int64) << 32 | sentence[ok], return_inverse=True)
    of, f = key >> 32, which[ok]
    share = len(y) / (2 * np.maximum(np.array([(1 - y).sum(), y.sum()]), 1))
    cost = np.where(y == 1, share[1], share[0])
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    w += 2.0
    for t in range(1, steps + 1):
        z = BIAS + np.bincount(s, w[f], len(of))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_none = np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
        some = np.maximum(1 - np.exp(log_none), 1e-9)
        # d loss / d log_none: 1 - y/some for the noisy-or
        g_doc = cost * np.where(y == 1, np.exp(log_none) / some, -1.0)
        g_z = -g_doc[of] * p  # log(1-p) falls by p for each unit of z
        g = np.bincount(f, g_z[s], n) / len(y) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def score_documents(docs: DataFrame, model: Model, *, locate: bool = False, name: str = "score") -> DataFrame:
    """All columns of docs, and the score (under name) and (if locate) offending: the numbers of the sentences, from 0, of probability 0.5 or more."""
    new = [name, *(["offending"] if locate else [])]
    own = [c for c in docs.columns if c not in new and c != "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.small(batches):
            x, sentence, first, base = word_features(b.column("text"))
            at, which = model.find(x.ravel())
            word = at // x.shape[1]
            cells = _distinct(sentence[word], which)
            s, i = np.unique(cells[0], return_inverse=True)
            z = BIAS + np.bincount(i.ravel(), model.weights[cells[1]], len(s)) if len(s) else np.zeros(0)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            row = np.searchsorted(base, s, side="right") - 1
            score = 1 - np.exp(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), b.num_rows)) if len(s) else np.zeros(b.num_rows)
            cols = [pa.array(np.clip(score, 0, 1))]
            if locate:
                high = p >= 0.5
                size = np.bincount(row[high], minlength=b.num_rows)
                cols.append(
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                        pa.array((s - base[row])[high].astype(np.int32)),
                    )
                )
            yield pa.record_batch(
                [*(b.column(f"__own_{k}") for k in range(len(own))), b.column("text"), *cols],
                names=[*(f"__own_{k}" for k in range(len(own))), "text", *(f"__new_{k}" for k in range(len(new)))],
            )

    named = docs.select(*(F.col(f"`{c}`").alias(f"__own_{k}") for k, c in enumerate(own)), "text")
    schema = named.select("*").schema.add("__new_0", "double")
    if locate:
        schema = schema.add("__new_1", T.ArrayType(T.IntegerType()))
    out = named.mapInArrow(scan, schema)
    at = {c: F.col(f"__own_{k}").alias(c) for k, c in enumerate(own)} | {"text": F.col("text")}
    return out.select(*(at[c] for c in docs.columns if c in at), *(F.col(f"__new_{k}").alias(c) for k, c in enumerate(new)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
