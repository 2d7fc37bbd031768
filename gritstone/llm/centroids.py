"""Clustering around centroids in exact integer arithmetic, by sort-means.

Components become floor(scale * x), kept as 32-bit integers, 4 bytes a component. Each round the driver orders, for each
centroid, the other centroids by their distance from it. A vector starts at the centroid it was assigned to before and
scans the others in that order. It stops at the first one that is strictly more than twice as far from the previous
centroid as the vector is: by the triangle inequality neither it nor any later one can be nearer or as near. One at
exactly twice the distance is still looked at, since it may tie and have the smaller number.

Vectors with their assignment are written to the shared folder each round and the round before is removed, so a lost
executor costs the tasks it ran, never earlier rounds. Only (centroid, component) sums are shuffled, one row per task
each; the driver sees k * (dims + 1) numbers a round. Distances are computed in doubles where all sums stay below 2**53,
which is exact, and in 64-bit integers beyond.

Cases: vectors that are null, of another length, or with a null or non-finite component are left out; fewer vectors than
k start fewer centroids, and without any there are no rows; repeated rows and ids are separate vectors; a null id takes
part and hashes as the word null; equal centroids tie and the smaller number wins; extra columns are left out. A
component beyond LARGEST after scaling is an error, since distances might not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.common import clipped, discard, written

#: Of a scaled component: squared distances over 64 components then stay below 2**62.
LARGEST = 1 << 27


def quantised(table: DataFrame, *, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, vector (little-endian 32-bit integers) of the vectors that are kept."""
    rows = clipped(table, id_col, vector_col).toDF("id", "vector")

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dims), False))
            values = pc.cast(batch.column(1).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # a null becomes NaN
            finite = np.isfinite(values).all(axis=1)
            whole = np.floor(scale * values[finite])
            if len(whole) and np.abs(whole).max() > LARGEST:
                raise OverflowError(f"a component times {scale} is beyond {LARGEST}")
            packed = np.ascontiguousarray(whole.astype("<i4")).view(f"V{4 * dims}").ravel().tolist()
            yield pa.record_batch([batch.column(0).filter(pa.array(finite)), pa.array(packed, pa.binary())], names=["id", "vector"])

    return rows.mapInArrow(scaled, f"id {rows.schema['id'].dataType.simpleString()}, vector binary")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a binary column, without a copy."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset :]
    return np.frombuffer(column.buffers()[2], "<i4", len(column) * dims, int(bounds[0])).reshape(-1, dims) if len(column) else np.zeros((0, dims), "<i4")


def _squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances."""
    apart = vectors - centroid
    return np.einsum("ij,ij->i", apart, apart).astype(np.int64)


def neighbour_order(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others from near to far (ties by number), and their squared distances."""
    between = np.stack([_squared(centroids, c) for c in centroids])
    order = np.argsort(between, axis=1, kind="stable")
    order = np.stack([row[row != k] for k, row in enumerate(order)])
    return order, np.take_along_axis(between, order, axis=1)


def nearest(vectors: np.ndarray, previous: np.ndarray, centroids: np.ndarray, order: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's centroid (ties: the smaller number), its squared distance, and how many distances it took."""
    kind = np.float64 if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < 1 << 22 and vectors.shape[1] <= 128 else np.int64
    chosen, distance, taken = previous.copy(), np.zeros(len(vectors), np.int64), 0
    exact = centroids.astype(kind)
    for own in np.unique(previous):
        rows = np.flatnonzero(previous == own)
        held = vectors[rows].astype(kind)
        first = _squared(held, exact[own])
        best, best_at, live = first.copy(), np.full(len(rows), own), np.arange(len(rows))
        taken += len(rows)
        for other, apart in zip(order[own], between[own], strict=True):
            live = live[apart <= 4 * first[live]]  # beyond twice the distance: this one and all later ones are out
            if not len(live):
                break
            found = _squared(held[live], exact[other])
            taken += len(live)
            better = (found < best[live]) | ((found == best[live]) & (other < best_at[live]))
            at = live[better]
            best[at], best_at[at] = found[better], other
        chosen[rows], distance[rows] = best_at, best
    return chosen, distance, taken


def _assigned(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, vector, cluster, distance after one round; state has the cluster of the round before."""
    order, between = neighbour_order(centroids)
    dims, kind = centroids.shape[1], state.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, distance, _ = nearest(_matrix(batch.column(1), dims), batch.column(2).to_numpy(), centroids, order, between)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(chosen, pa.int32()), pa.array(distance, pa.int64())], names=["id", "vector", "cluster", "distance"])

    return state.select("id", "vector", "cluster").mapInArrow(assign, f"id {kind}, vector binary, cluster int, distance bigint")


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors by component; empty clusters keep their centroid."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            vectors, cluster = _matrix(batch.column(0), dims), batch.column(1).to_numpy()
            for c in np.unique(cluster):
                own = vectors[cluster == c]
                total[c, :dims] += own.sum(axis=0, dtype=np.int64)
                total[c, dims] += len(own)
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "part"])

    rows = state.select("vector", "cluster").mapInArrow(sums, "cell bigint, part bigint").groupBy("cell").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    total = np.zeros(k * (dims + 1), object)
    for r in rows:
        total[r["cell"]] = int(r["total"])
    total = total.reshape(k, dims + 1)
    return np.array([[int(s // n) for s in row] if n else old.tolist() for row, n, old in zip(total[:, :dims], total[:, dims], centroids, strict=True)], np.int64)


def cluster_vectors(table: DataFrame, *, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """id, vector, cluster and squared distance of every kept vector, and the final centroids (k x dims, or fewer rows).

    Starts from the k vectors whose id has the least SHA-256 together with the seed. The rounds end early once no
    centroid moves, which changes nothing.
    """
    spark = table.sparkSession
    base, path = written(quantised(table, dims=dims, scale=scale, id_col=id_col, vector_col=vector_col), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    start = base.orderBy(digest, "vector").limit(k).collect()
    centroids = np.array([np.frombuffer(r["vector"], "<i4") for r in start], np.int64).reshape(-1, dims)
    state = base.withColumn("cluster", F.lit(0))
    if not len(centroids):
        return state.withColumn("distance", F.lit(0).cast("bigint")), centroids
    for _ in range(rounds):
        state, following = written(_assigned(state, centroids), "assigned")
        discard(spark, path)
        path, moved = following, _means(state, centroids)
        if (moved == centroids).all():
            break
        centroids = moved
    state, _ = written(_assigned(state, centroids), "assigned")
    discard(spark, path)
    return state, centroids


def op12(embeddings: DataFrame) -> DataFrame:
    state, centroids = cluster_vectors(embeddings)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = {r["cluster"]: int(r["total"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    rows = [(c, sums.get(c, 0), sum(sums.values()), d) for c, d in enumerate(digests)]
    centroid = state.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # one row per centroid, k of them
    return state.select(F.col("id").alias("vec_id"), "cluster", "distance").join(F.broadcast(centroid), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sql(k: int = 8, rounds: int = 10) -> str:
    """The same by plain assignment to the least of all k distances."""
    near = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        """kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM kept) WHERE c < {k})",
    ]
    for j in range(rounds + 1):
        parts.append(f"a{j} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (SELECT x.vec_id, x.v, c.c, {near} AS d FROM kept x, c{j} c) GROUP BY vec_id)")
        if j < rounds:
            parts.append(f"""s{j} AS (SELECT c, j, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS e, unnest(range(64)) AS j FROM a{j}) GROUP BY c, j),
c{j + 1} AS MATERIALIZED (
    SELECT c, coalesce(m.v, o.v) AS v FROM c{j} o
    LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{j} GROUP BY c) m USING (c))""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} f USING (c)"""
