"""Centroid clustering in whole numbers; the nearest centroid is found by the threshold algorithm.

Each dimension has its centroids in a sorted list. From a vector's own value the list is walked outward, one centroid a step,
in all dimensions at once. A centroid met for the first time gets its exact distance. What no list has reached is at least as far
as the lists' frontiers together, so a vector is done when the sum of its squared frontier distances is strictly above its best
distance: at equality a centroid of a smaller number could still come.

A round is one pass: tasks assign their vectors and add them up by cluster, Spark adds up the tasks' sums, and the driver
gets one row for each cluster and dimension, whatever the number of vectors. All sums are exact, so rows may be in any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import unused, written

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components below this in size have squared distances that fit in 64 bits, for up to 64 of them.
LARGEST = 1 << 27
#: Vectors worked on at a time.
BLOCK = 2048


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid (the smaller of equals) and its squared distance, in whole numbers."""
    n, d = x.shape
    k = len(centroids)
    who = np.argsort(centroids, axis=0, kind="stable")  # by dimension
    values = np.take_along_axis(centroids, who, 0)
    best = np.full(n, np.iinfo(np.int64).max)
    label = np.zeros(n, np.int64)
    met = np.zeros((n, k), bool)
    right = np.stack([np.searchsorted(values[:, j], x[:, j]) for j in range(d)], axis=1) if n else np.zeros((0, d), np.int64)
    left, rows, far = right - 1, np.arange(n), np.iinfo(np.int64).max
    for _ in range(k):
        if not len(rows):
            break
        mine, lo, hi = x[rows], left[rows], right[rows]
        down = np.where(lo >= 0, mine - np.take_along_axis(values, np.maximum(lo, 0), 0), far)
        up = np.where(hi < k, np.take_along_axis(values, np.minimum(hi, k - 1), 0) - mine, far)
        go_down = down <= up
        at = np.take_along_axis(who, np.where(go_down, np.maximum(lo, 0), np.minimum(hi, k - 1)), 0)
        left[rows], right[rows] = lo - go_down, hi + ~go_down
        new = np.zeros((len(rows), k), bool)
        new[np.arange(len(rows))[:, None], at] = True
        new &= ~met[rows]
        met[rows] |= new
        for c in np.flatnonzero(new.any(axis=0)):  # ascending: of equal distances the smaller number stays
            these = rows[new[:, c]]
            distance = ((x[these] - centroids[c]) ** 2).sum(axis=1)
            better = (distance < best[these]) | (distance == best[these]) & (c < label[these])
            best[these[better]], label[these[better]] = distance[better], c
        frontier = np.where(go_down, down, up)
        rows = rows[((frontier**2).sum(axis=1) <= best[rows]) & ~met[rows].all(axis=1)]
    return label, best


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, BLOCK):
        some = batch.slice(at, BLOCK)
        x = some.column(some.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
        if len(x) and (x.max() >= LARGEST or x.min() <= -LARGEST):
            raise OverflowError(f"components of {LARGEST} or more have no exact distance in 64 bits")
        yield some, x


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, list[list[int]]]:
    """One row for each vector kept - id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 - and the final centroids.

    Kept are vectors of exactly ``dimensions`` components, none null, NaN or infinite; a component x counts as floor(scale * x).
    The start is the vectors with the smallest SHA-256 of "<seed>:<id>" (a null id: nothing behind the colon), rows that repeat an id by
    their components; of fewer vectors than ``clusters`` each is a centroid. Repeated rows count as often as they come. An empty
    table gives no rows. Components that reach 2**27 in size fail with OverflowError, as no distance of theirs is sure to fit."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(f"`{vector_col}`")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    kept = vectors.where((F.size(v) == dimensions) & whole)
    kept = written(kept.select(F.col(f"`{id_col}`").alias("tm_id"), F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("int")).alias("tm_v")), "cluster-vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("tm_id").cast("string"), F.lit(""))), 256)
    start = kept.orderBy(key, "tm_v").limit(clusters).select("tm_v").collect()  # as many rows as clusters
    centroids = np.array([r["tm_v"] for r in start], np.int64).reshape(-1, dimensions)
    id_type = kept.schema["tm_id"].dataType.simpleString()

    def sums(centroids: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = len(centroids)
            n, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
            for batch in batches:
                for _, x in _blocks(batch, dimensions):
                    label, _ = nearest(x, centroids)
                    n += np.bincount(label, minlength=k)
                    for c in np.unique(label):
                        total[c] += x[label == c].sum(axis=0)
            for c in np.flatnonzero(n):  # one row for each cluster and dimension
                yield pa.RecordBatch.from_arrays([pa.array(np.full(dimensions, c)), pa.array(np.arange(dimensions)), pa.array(np.full(dimensions, n[c])), pa.array(total[c])], names=["c", "d", "n", "s"])

        return run

    for _ in range(rounds if len(centroids) else 0):
        parts = kept.select("tm_v").mapInArrow(sums(centroids), "c long, d long, n long, s long")
        got = parts.groupBy("c", "d").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # clusters x dimensions rows
        moved = centroids.copy()
        for r in got:
            moved[r["c"], r["d"]] = int(r["s"]) // int(r["n"])
        if (moved == centroids).all():
            break  # the rounds that are left would change nothing
        centroids = moved

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in _blocks(batch, dimensions):
                label, distance = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(label, pa.int32()), pa.array(distance)], names=["tm_id", "cluster", "distance"])

    rows = written(kept.mapInArrow(assigned, f"tm_id {id_type}, cluster int, distance long"), "clustered")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    inertia = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(exact("distance").alias("s")).collect()}  # a row for each cluster
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), digest) for c, digest in enumerate(digests)]
    side = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.join(F.broadcast(side), "cluster").select(F.col("tm_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return out, centroids.tolist()


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """The columns of the kept vectors' rows and, under names that none of them has, tm_cluster and tm_distance. Ids are to be unique
    here: the rows are joined by them."""
    found, _ = cluster_vectors(vectors, id_col, vector_col, **how)
    names = {c: unused(vectors, f"tm_{c}") for c in ("cluster", "distance")}
    return vectors.join(found.select(id_col, *(F.col(c).alias(n) for c, n in names.items())), id_col)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMENSIONS) -> str:
    """Ten rounds written out. d * clusters + k has the smallest distance first, and of equals the smallest number."""
    away = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (e.v[i] - c.v[i]) * (e.v[i] - c.v[i])))::BIGINT"
    near = lambda r: f"a{r} AS MATERIALIZED (SELECT e.row, e.vec_id, e.v, min({away}::HUGEINT * {clusters} + c.k) AS m FROM kept e CROSS JOIN c{r} c GROUP BY e.row, e.vec_id, e.v)"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k, v FROM kept QUALIFY k < {clusters})",
    ]
    for r in range(rounds):
        steps += [
            near(r),
            f"s{r} AS (SELECT (m % {clusters})::BIGINT AS k, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY 1, 2)",
            f"m{r} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY k)",
            f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.k = c.k)",
        ]
    steps.append(near(rounds))
    steps.append(f"f AS (SELECT vec_id, (m % {clusters})::INTEGER AS cluster, (m // {clusters})::BIGINT AS distance FROM a{rounds})")
    return f"""WITH {', '.join(steps)} SELECT f.vec_id, f.cluster, f.distance, (sum(f.distance) OVER (PARTITION BY f.cluster))::BIGINT AS cluster_inertia, (sum(f.distance) OVER ())::BIGINT AS inertia,
sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM f JOIN c{rounds} c ON c.k = f.cluster"""


SQL = _sql()
