"""Ball k-means: exact Lloyd rounds in which a vector is compared only with the centroids that can be nearer than its own.

A cluster is a ball: its centroid and the radius, the greatest distance of a member. Another centroid can be as near to a member x as
its own c only if it is within 2 |x - c| of c, so a ball's neighbours are the centroids within twice its radius. Sorted by
distance they cut the ball into a stable core (nearer than half the nearest neighbour's distance: nothing is compared) and annuli, whose k-th
is compared with the k nearest neighbours. All distances are squared integers, so that ties (the smaller number wins) are exact.

A round is three passes of tasks over vectors and their clusters: radii, assignment, sums; each sends a row for each cluster and batch at most to
an aggregation, and the driver gets a row for each cluster. The assignment is written to the shared folder and read from there; the one
before goes. At the start all vectors are in the ball of centroid 0.

Components are floor(scale * x). Vectors of another length, with a null or non-finite component, or with one beyond +-LIMIT (whose distances
don't fit 64 bits) aren't kept. Each row counts as a vector, also if it repeats another's vec_id or components; first centroids of
one vec_id are taken in order of their components. A null vec_id is an empty one in the order of the first centroids. Fewer vectors than clusters
give fewer clusters, an empty table none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import remove, shared_folder

#: The greatest component: 64 squared differences of twice as much, times 4, are below 2 ** 63.
LIMIT = 1 << 26
#: Rows at a time: the differences to a centroid take 8 bytes a component.
ROWS = 4096
VECTORS = "vec_id long, v binary"
STATE = "vec_id long, v binary, cluster int, distance long"
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _packed(x: np.ndarray) -> pa.Array:
    """A binary value for each row of int32 components."""
    wide = x.shape[1] * 4
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(wide)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x, dtype="<i4"))])


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    data, _ = K.text_bytes(column)
    return data.view("<i4").reshape(-1, dims).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)
    K.give_back()


def kept_vectors(embeddings: DataFrame, dims: int = 64, scale: float = 64.0) -> DataFrame:
    """vec_id and components, as 32-bit integers, of the vectors that can be clustered."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            size = b.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(size == dims))
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * x)
                ok = (np.abs(x) <= LIMIT).all(axis=1)  # false for nan and inf, too
            yield pa.record_batch([b.column(0).filter(pa.array(ok)), _packed(x[ok].astype(np.int32))], names=["vec_id", "v"])

    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(scan, VECTORS)


def first_centroids(vectors: DataFrame, clusters: int, salt: str, dims: int) -> np.ndarray:
    """The vectors whose salted vec_id has the smallest hashes: clusters rows come to the driver."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name, 256).alias("hash"), "v").orderBy("hash", "v").limit(clusters).collect()
    return np.array([np.frombuffer(r.v, "<i4") for r in rows], dtype=np.int64).reshape(len(rows), dims)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def neighbours(centroids: np.ndarray, radii: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each ball (squared radius), the other centroids within twice its radius and their squared distances, both by distance."""
    out = {}
    for c, r in radii.items():
        d = squared(centroids, centroids[c])
        near = [j for j in np.lexsort((np.arange(len(d)), d)).tolist() if j != c and d[j] <= 4 * r]
        out[c] = np.array(near, dtype=np.int64), d[near]
    return out


def nearest(x: np.ndarray, cluster: np.ndarray, centroids: np.ndarray, near: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid, its squared distance, and how many distances to other centroids were taken. cluster: where the vectors are now."""
    best, distance = cluster.copy(), squared(x, centroids[cluster])
    compared = 0
    for c in np.unique(cluster).tolist():
        others, at = near[c]
        members = np.flatnonzero(cluster == c)
        ring = np.searchsorted(at, 4 * distance[members], side="right")  # 0 is the stable core
        for k in range(int(ring.max(initial=0))):
            rows, j = members[ring > k], int(others[k])
            d = squared(x[rows], centroids[j])
            compared += len(rows)
            better = (d < distance[rows]) | ((d == distance[rows]) & (j < best[rows]))
            best[rows[better]], distance[rows[better]] = j, d[better]
    return best, distance, compared


def radii(state: DataFrame, centroids: np.ndarray) -> dict[int, int]:
    """The squared radius of each cluster that has members, around its new centroid."""
    dims = centroids.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            cluster = b.column(1).to_numpy()
            most = np.full(len(centroids), -1, dtype=np.int64)
            np.maximum.at(most, cluster, squared(_vectors(b.column(0), dims), centroids[cluster]))
            have = np.flatnonzero(most >= 0)
            yield pa.record_batch([pa.array(have, pa.int32()), pa.array(most[have])], names=["cluster", "r"])

    found = state.select("v", "cluster").mapInArrow(scan, "cluster int, r long").groupBy("cluster").agg(F.max("r").alias("r"))
    return {r.cluster: r.r for r in found.collect()}


def assigned(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The vectors with their nearest centroids."""
    dims, near = centroids.shape[1], neighbours(centroids, radii(state, centroids))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            cluster = b.column(2).to_numpy().astype(np.int64)
            best, distance, _ = nearest(_vectors(b.column(1), dims), cluster, centroids, near)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(best, pa.int32()), pa.array(distance)], names=["vec_id", "v", "cluster", "distance"])

    return state.select("vec_id", "v", "cluster").mapInArrow(scan, STATE)


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the clusters' exact means; centroids of empty clusters stay."""
    dims = centroids.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            x, cluster = _vectors(b.column(0), dims), b.column(1).to_numpy()
            have = np.unique(cluster)
            sums = np.array([x[cluster == c].sum(axis=0) for c in have]).reshape(-1)
            rows = np.repeat(have, dims)
            count = np.repeat([int((cluster == c).sum()) for c in have], dims)
            place = np.tile(np.arange(dims), len(have))
            yield pa.record_batch(
                [pa.array(rows, pa.int32()), pa.array(place, pa.int32()), pa.array(sums, pa.int64()), pa.array(count, pa.int64())],
                names=["cluster", "place", "total", "n"],
            )

    parts = state.select("v", "cluster").mapInArrow(scan, "cluster int, place int, total long, n long")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # clusters x dims rows
        out[r.cluster, r.place] = r.total // r.n
    return out


def cluster(embeddings: DataFrame, clusters: int = 16, rounds: int = 3, *, dims: int = 64, scale: float = 64.0, salt: str = "1") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance) and the final centroids."""
    spark = embeddings.sparkSession
    paths: list[str] = []

    def written(df: DataFrame) -> DataFrame:
        """Once it is written, what it was computed from goes."""
        paths.append(shared_folder(spark, "balls"))
        df.write.parquet(paths[-1])
        if len(paths) > 1:
            remove(spark, paths.pop(0))
        return spark.read.schema(df.schema).parquet(paths[-1])

    vectors = written(kept_vectors(embeddings, dims, scale))
    centroids = first_centroids(vectors, clusters, salt, dims)
    state = vectors.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")})
    if not len(centroids):
        return state, centroids
    for _ in range(rounds):
        state = written(assigned(state, centroids))
        centroids = moved(state, centroids)
    return written(assigned(state, centroids)), centroids


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    inertia = {r.cluster: r.s for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each cluster
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = [(i, inertia.get(i, 0), sum(inertia.values()), s) for i, s in enumerate(names)]
    sums = spark.createDataFrame(about, "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(sums), F.col("cluster") == F.col("of")).select(*(c.split()[0] for c in OUT.split(", ")))  # as many rows as clusters
