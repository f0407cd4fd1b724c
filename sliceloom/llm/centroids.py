"""Centroid clustering of integer vectors, exact to the last bit, by partial-distance search.

Vectors become integers once, so sums, means and distances do not depend on the order of rows or on partitions.
Dimensions are taken by falling variance: after a few of them most centroids are already farther than the best one
is in all, and are abandoned. Every round moves one partial sum a task and centroid, never vectors; the driver holds
the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceloom.llm.store import save

#: Centroids, rounds of moving them, components of a vector, steps of the grid to one unit.
CENTROIDS, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
#: Dimensions that all centroids are compared in first, and dimensions between two looks at the best distance.
LEAD, STEP = 8, 8
#: Grid steps beyond which a component is held, so that squared distances fit 64 bits.
FARTHEST = 2**27
#: Vectors that are compared at a time.
BLOCK = 4096


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): rows with exactly `dims` components, none null or non-finite, as floor(scale * x)."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == dims) & finite)
    held = lambda c: F.greatest(F.lit(-float(FARTHEST)), F.least(F.lit(float(FARTHEST)), c * scale))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(held(c)).cast("long")).alias("v"))


def seed_key(vec_id: Column) -> Column:
    return F.sha2(F.encode(F.concat(F.lit("1:"), vec_id.cast("string")), "UTF-8"), 256)


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of the nearest of `centroids` to each row of x, ties to the smaller number, and how many components were compared.

    All centroids are compared in the first LEAD dimensions of `order`. The closest there is finished and sets the best
    distance; each other one goes on STEP dimensions at a time with the rows where it is not yet strictly above the
    best, and those that reach the end have their whole distance.
    """
    x, c = x[:, order], centroids[:, order]
    n, dims = x.shape
    part = np.empty((n, len(c)), np.int64)
    for k in range(len(c)):
        d = x[:, :LEAD] - c[k, :LEAD]
        part[:, k] = np.einsum("ij,ij->i", d, d)
    which = part.argmin(axis=1)
    d = x[:, LEAD:] - c[which, LEAD:]
    best = part[np.arange(n), which] + np.einsum("ij,ij->i", d, d)
    compared = n * (len(c) * min(LEAD, dims) + max(0, dims - LEAD))
    first = which.copy()
    for k in range(len(c)):
        alive = np.flatnonzero((part[:, k] <= best) & (first != k))
        total = part[alive, k]
        for i in range(LEAD, dims, STEP):
            if not len(alive):
                break
            d = x[alive, i : i + STEP] - c[k, i : i + STEP]
            compared += d.size
            total = total + np.einsum("ij,ij->i", d, d)
            stays = total <= best[alive]
            alive, total = alive[stays], total[stays]
        better = (total < best[alive]) | (which[alive] > k)
        best[alive[better]], which[alive[better]] = total[better], k
    return which, best, compared


def dimension_order(kept: DataFrame, dims: int = DIMS) -> np.ndarray:
    """Dimensions by falling variance over all vectors; sums by task, so the driver gets one row. The order only decides how soon a centroid is abandoned."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            x = _rows(batch.column("v"), dims).astype(np.float64)
            n, one, two = n + len(x), one + x.sum(axis=0), two + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"n": [float(n)], "one": [one.tolist()], "two": [two.tolist()]})

    parts = kept.select("v").mapInArrow(sums, "n double, one array<double>, two array<double>")
    summed = lambda name: F.array(*[F.sum(F.col(name)[i]) for i in range(dims)])
    row = parts.agg(F.sum("n").alias("n"), summed("one").alias("one"), summed("two").alias("two")).first()
    if not row["n"]:
        return np.arange(dims)
    one, two = np.array(row["one"]), np.array(row["two"])
    return np.argsort(-(two / row["n"] - (one / row["n"]) ** 2), kind="stable")


def _moved(kept: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Centroids at the floor of their vectors' mean; one without vectors stays."""
    dims = centroids.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            x = _rows(batch.column("v"), dims)
            for i in range(0, len(x), BLOCK):
                which, _, _ = nearest(x[i : i + BLOCK], centroids, order)
                n += np.bincount(which, minlength=len(centroids))
                for k in np.unique(which):
                    total[k] += x[i : i + BLOCK][which == k].sum(axis=0)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(n[met], pa.int64()), pa.array(total[met].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    parts = kept.select("v").mapInArrow(sums, "cluster int, n long, total array<long>")
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[exact(F.col("total")[i]) for i in range(dims)]).alias("total")).collect():
        out[r["cluster"]] = [int(t) // r["n"] for t in r["total"]]
    return out


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(rows, final centroids on the grid); rows: vec_id, cluster int, distance long, for every vector kept.

    Kept are vectors of exactly `dims` components without null or non-finite ones, as integers floor(scale * x);
    components beyond FARTHEST steps are held there. The first centroids are the kept vectors with the smallest
    sha256 of `1:<vec_id>`, ties by components, rows without id last; with fewer vectors there are fewer. A round
    gives each vector to its nearest centroid by squared distance (ties: the smaller number) and moves each centroid to
    the floor of its vectors' mean; one without vectors stays. Equal rows are rows like others, and where two
    centroids are equal the larger number gets none. Other columns play no part; without any kept vector the result is empty.
    The quantized vectors are written once and read in every pass; the driver gets `centroids` rows a pass.
    """
    kept = save(quantized(vectors, vec_id, embedding, dims, scale), "quantized")
    first = kept.select(seed_key(F.col("vec_id")).alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(centroids)
    at = np.array([r["v"] for r in first.collect()], np.int64).reshape(-1, dims)
    if not len(at):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), at
    order = dimension_order(kept, dims)
    for _ in range(rounds):
        at = _moved(kept, at, order)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column("v"), dims)
            for i in range(0, len(x), BLOCK):
                which, distance, _ = nearest(x[i : i + BLOCK], at, order)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(i, BLOCK), pa.array(which, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return save(kept.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned"), at


def with_inertia(rows: DataFrame, at: np.ndarray) -> DataFrame:
    """Rows of cluster() with cluster_inertia and inertia, the distances summed over a cluster and over all (null beyond 64 bits), and centroid_sha256, the digest of the centroid's components joined by commas."""
    schema = "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 2**63 else None
    of = [(k, fits(s), fits(sum(sums.values())), centroid_digest(at[k])) for k, s in sums.items()]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(of, schema)), F.col("cluster") == F.col("_cluster")).drop("_cluster")
