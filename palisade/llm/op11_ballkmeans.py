"""Centroid clustering by ball k-means, in whole numbers.

A cluster is a ball: its centroid and a bound of its members' distances from it. The bound after an update is the
farthest member's distance from the old centroid plus the centroid's shift, rounded up. Centroids within twice a ball's
bound are its neighbours, and only those can take members. Sorted by distance, they cut the ball into a stable core
(nearer to its centroid than half the way to the first neighbour: stays, nothing is compared) and annuli: a member of an
annulus is compared, exactly, with the neighbours up to that annulus alone. All tests are on squared whole numbers and
non-strict where a tie could change the answer, so the result equals a comparison with all centroids.

A round is one pass that reads vectors with their cluster and writes them with the next one; every task adds a row a
cluster with its sums, so the centroids come from at most clusters x tasks short rows of the same write. The driver
holds the centroids only. The previous round's table goes once the next one is written.

Edge cases: vectors that are null, of another length, or hold null or non-finite components are left out; an empty table
gives no rows; fewer vectors than clusters give as many clusters as vectors; rows of a null vec_id are clustered but
start a cluster only when too few have ids; equal ids are told apart by their vectors; repeated rows count each; extra columns
are ignored; components beyond 2 ** 25 after scaling are an error (distances would not fit a long).
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.vectors import floor_mean, kind, matrix, sound, whole
from palisade.session import cut, drop_cut

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2"

STATE = "vec_id long, x array<int>, cluster int, distance long, n long, far long, cost long, sums array<long>"
ARROW = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("n", pa.int64()), ("far", pa.int64()), ("cost", pa.int64()), ("sums", pa.list_(pa.int64()))])


class Balls:
    """Centroids, and for each ball its neighbour centroids by distance."""

    def __init__(self, centroids: list[list[int]], bounds: list[int | None]):
        """bounds: of each ball's radius, rounded up; None where nothing is known (then all centroids are neighbours)."""
        self.centroids = np.array(centroids, np.int64).reshape(len(centroids), -1)
        self.neighbours: list[list[tuple[int, int]]] = []
        for i, bound in enumerate(bounds):
            gaps = ((self.centroids - self.centroids[i]) ** 2).sum(axis=1)
            near = [(int(g), j) for j, g in enumerate(gaps) if j != i and (bound is None or int(g) <= 4 * bound * bound)]
            self.neighbours.append(sorted(near))

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid (ties: the smaller number) and its squared distance for rows that belong to clusters own; and
        how many distances to other centroids were computed."""
        exact = x.dtype == np.float64 and kind(self.centroids, x.shape[1]) is np.float64
        centroids, x = (a.astype(np.float64 if exact else np.int64, copy=False) for a in (self.centroids, x))
        square = np.einsum("ij,ij->i", x, x)
        cluster, distance, compared = own.copy(), np.zeros(len(x), np.int64), 0
        for i in np.unique(own):
            rows = np.flatnonzero(own == i)
            mine = self._squared(x, square, rows, centroids[i])
            best, at = mine.copy(), np.full(len(rows), i, own.dtype)
            for gap, j in self.neighbours[i]:
                ring = np.flatnonzero(4 * mine >= gap)  # the annuli from this neighbour outwards
                if not len(ring):
                    break
                d = self._squared(x, square, rows[ring], centroids[j])
                compared += len(ring)
                nearer = (d < best[ring]) | ((d == best[ring]) & (j < at[ring]))
                best[ring[nearer]], at[ring[nearer]] = d[nearer], j
            cluster[rows], distance[rows] = at, best
        return cluster, distance, compared

    @staticmethod
    def _squared(x, square, rows, c) -> np.ndarray:
        return (square[rows] - 2 * (x[rows] @ c) + c @ c).astype(np.int64)


def _round(balls: Balls, dims: int):
    """The mapInArrow function of a round: rows with their next cluster, then a row a cluster with the task's sums."""

    def run(batches):
        k = len(balls.centroids)
        n, far, cost = (np.zeros(k, np.int64) for _ in range(3))
        sums = np.zeros((k, dims), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x"), dims)
            cluster, distance, _ = balls.assign(x, b.column("cluster").to_numpy(zero_copy_only=False))
            for i in np.unique(cluster):
                rows = cluster == i
                n[i] += rows.sum()
                far[i] = max(far[i], distance[rows].max())
                cost[i] += distance[rows].sum()
                sums[i] += x[rows].sum(axis=0).astype(np.int64)
            none = [pa.nulls(b.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x").cast(ARROW.field("x").type), pa.array(cluster, pa.int32()), pa.array(distance), *none], schema=ARROW)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(len(used), pa.int64()), pa.nulls(len(used), ARROW.field("x").type), pa.array(used, pa.int32()), pa.nulls(len(used), pa.int64()),
            pa.array(n[used]), pa.array(far[used]), pa.array(cost[used]), pa.array(list(sums[used]), pa.list_(pa.int64())),
        ], schema=ARROW)

    return run


def _starts(vectors: DataFrame, clusters: int, seed: str) -> list[list[int]]:
    """The first centroids: the vectors of smallest sha256 of seed:vec_id."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r["x"]) for r in vectors.select(name.alias("name"), "x").orderBy(F.asc_nulls_last("name"), "x").limit(clusters).collect()]


def _moved(centroids: list[list[int]], bounds: list[int | None], got: dict) -> tuple[list[list[int]], list[int | None]]:
    """Centroids and bounds of the balls after a round; an empty cluster stays."""
    out, reach = [], []
    for i, old in enumerate(centroids):
        if i not in got:
            out.append(old)
            reach.append(0)
            continue
        new = [floor_mean(s, got[i]["n"]) for s in got[i]["sums"]]
        shift = sum((a - b) ** 2 for a, b in zip(old, new))
        out.append(new)
        reach.append(isqrt(got[i]["far"]) + 1 + (isqrt(shift) + 1 if shift else 0))
    return out, reach


def ball_kmeans(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, list[dict]]:
    """(assignments, clusters) of vectors (vec_id, embedding): vec_id, x array<int>, cluster int, distance long a row; and a
    dict a cluster (centroid, n, cost)."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(sound("embedding") & (F.size("embedding") == dims))
    rows = kept.select("vec_id", whole("embedding", scale).alias("x"))
    centroids = _starts(rows, clusters, seed)
    bounds: list[int | None] = [None] * len(centroids)
    rows, before, got = rows.withColumn("cluster", F.lit(0)), None, {}
    for step in range(rounds + 1 if centroids else 0):
        now = cut(rows.mapInArrow(_round(Balls(centroids, bounds), dims), STATE), "balls")
        if before is not None:
            drop_cut(before)
        before, rows = now, now.where("n is null").select("vec_id", "x", "cluster")
        total = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dims)]
        partial = now.where("n is not null").groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("cost").alias("cost"), *total)
        got = {r["cluster"]: {"n": r["n"], "far": r["far"], "cost": r["cost"], "sums": [r[f"s{d}"] for d in range(dims)]} for r in partial.collect()}  # one row a cluster
        if step < rounds:
            centroids, bounds = _moved(centroids, bounds, got)
    if before is None:
        return rows.select("vec_id", "x", "cluster", F.lit(0).cast("long").alias("distance")).limit(0), []
    found = [{"centroid": c, "n": got.get(i, {"n": 0})["n"], "cost": got.get(i, {"cost": 0})["cost"]} for i, c in enumerate(centroids)]
    return before.where("n is null").select("vec_id", "x", "cluster", "distance"), found


def op11_ballkmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = ball_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    named = [(i, c["cost"], hashlib.sha256(",".join(map(str, c["centroid"])).encode()).hexdigest()) for i, c in enumerate(found)]
    balls = spark.createDataFrame(named, "cluster int, cluster_inertia long, centroid_sha256 string")  # a row a cluster
    inertia = F.lit(sum(c["cost"] for c in found)).cast("long")
    return rows.join(F.broadcast(balls), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", inertia.alias("inertia"), "centroid_sha256")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> str:
    """DuckDB SQL that compares every vector with every centroid in every round."""
    near = """a{r} AS MATERIALIZED (SELECT v.vec_id, v.x, arg_min(c.cluster, (list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x), c.cluster)) AS cluster,
 CAST(min(list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x)) AS BIGINT) AS distance FROM kept v, c{r} c GROUP BY v.rid, v.vec_id, v.x)"""
    mean = """m{r} AS MATERIALIZED (SELECT cluster, pos, CAST(floor(CAST(sum(CAST(val AS BIGINT)) AS HUGEINT) / count(*)) AS DOUBLE) AS val FROM (SELECT cluster, unnest(x) AS val, unnest(range(1, {d})) AS pos FROM a{p}) GROUP BY cluster, pos),
c{r} AS MATERIALIZED (SELECT c.cluster, coalesce(list(m.val ORDER BY m.pos) FILTER (m.val IS NOT NULL), c.x) AS x FROM c{p} c LEFT JOIN m{r} m USING (cluster) GROUP BY c.cluster, c.x)"""
    steps = [near.format(r=0)]
    for r in range(1, rounds + 1):
        steps += [mean.format(r=r, p=r - 1, d=dims + 1), near.format(r=r)]
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda v: floor(CAST(v AS DOUBLE) * {scale})) AS x FROM embeddings
 WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS INTEGER) AS cluster, x FROM kept QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) <= {clusters}),
{", ".join(steps)}
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(list_transform(c.x, lambda v: CAST(v AS BIGINT)), ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""


ORACLE = oracle()
