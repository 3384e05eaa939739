"""Operator 12, centroid clustering by a bisector tournament.

Vectors become integers floor(scale * x). The number of a vector's nearest centroid is found without computing its
distance to every centroid: for centroids i < j the integer n = 2 (c_j - c_i) and the threshold t = |c_j|^2 - |c_i|^2 are
prepared once, and n . v - t is the squared distance to c_i less that to c_j. Its sign settles the pair, and
zero favours i. The k centroids meet in a knock-out of k - 1 such tests; every round pairs neighbours, so the one
with the smaller number is always on the left. The distance to the winner alone is then computed, in whole numbers.

Every round is one pass over the stored integer vectors: tasks add up counts and components per cluster, Spark adds those up, and
k * dims sums (bounded, whatever the table) reach the driver, which forms the next centroids with exact floor division.
Cluster sizes don't matter: no row moves to its cluster, so a cluster of a third of all rows is as cheap as any.

Defined results: vectors of another length, with a null, NaN or infinite component, and null vectors leave; a component whose
integer is beyond 2^27 is an error (its squared distances need not fit 64 bits); rows that repeat an id are vectors of their
own; starting vectors with equal hashes (repeated ids) are taken in the order of their components; null ids come after all others;
equal starting centroids are settled by the smaller number, the others stay empty where they are; a table with fewer than k
vectors has fewer centroids, one without vectors gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import spool

DIMS = 64
K = 16
ROUNDS = 3
SCALE = 64
LARGEST = 1 << 27


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """id and v (array<int>) of the vectors that are kept."""
    def run(batches):
        for b in batches:
            vecs = b.column("v")
            right = np.flatnonzero(np.asarray(vecs.value_lengths().fill_null(-1)) == dims)
            part = vecs.take(pa.array(right))
            flat = part.flatten()
            x = flat.to_numpy(zero_copy_only=False).reshape(len(right), dims)  # nulls become NaN
            fine = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                v = np.floor(scale * x[fine])
            if (np.abs(v) > LARGEST).any():
                raise ValueError(f"a component is beyond {LARGEST} / {scale}")
            offsets = pa.array(np.arange(0, (len(v) + 1) * dims, dims, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(right[fine])), pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32).ravel()))], ["id", "v"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<int>")


class Tournament:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        c = np.array(centroids, np.int64)
        self.centroids, self.k = c, len(c)
        self.normals = 2 * (c[None, :, :] - c[:, None, :])  # [i, j]: 2 (c_j - c_i)
        squares = (c * c).sum(axis=1)
        self.thresholds = squares[None, :] - squares[:, None]

    def winners(self, v: np.ndarray) -> np.ndarray:
        """The nearest centroid of each row, the smallest number on ties; k - 1 sign tests a row."""
        alive = [np.full(len(v), i, np.int64) for i in range(self.k)]
        fixed = True  # in the first round every row meets the same pairs
        while len(alive) > 1:
            ahead = []
            for a, b in zip(alive[::2], alive[1::2]):
                if fixed:
                    side = v @ self.normals[a[0], b[0]] - self.thresholds[a[0], b[0]] if len(v) else np.zeros(0, np.int64)
                else:
                    side = np.einsum("nd,nd->n", v, self.normals[a, b]) - self.thresholds[a, b]
                ahead.append(np.where(side > 0, b, a))
            alive, fixed = ahead + alive[len(alive) // 2 * 2:], False
        return alive[0]

    def distances(self, v: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        gap = v - self.centroids[cluster]
        return (gap * gap).sum(axis=1)


def _rows(batch) -> np.ndarray:
    v = batch.column("v")
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), -1) if len(v) else np.zeros((0, 1), np.int64)


def next_centroids(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: assign, then the floor of each cluster's mean; an empty cluster's centroid stays."""
    def run(batches):
        meet = Tournament(centroids)
        n, sums = np.zeros(meet.k, np.int64), np.zeros(meet.centroids.shape, np.int64)
        for b in batches:
            v = _rows(b)
            if len(v):
                cluster = meet.winners(v)
                n += np.bincount(cluster, minlength=meet.k)
                for i in np.unique(cluster):
                    sums[i] += v[cluster == i].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.column_stack([n, sums])[some].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = vectors.mapInArrow(run, "cluster long, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "x"))
    out = [list(c) for c in centroids]
    count: dict[int, int] = {}
    rows = parts.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # at most k * (dims + 1)
    for r in rows:
        if r["at"] == 0:
            count[r["cluster"]] = int(r["x"])
    for r in rows:
        if r["at"]:
            out[r["cluster"]][r["at"] - 1] = int(r["x"]) // count[r["cluster"]]
    return out


def first_centroids(vectors: DataFrame, k: int = K, seed: int = 1) -> list[list[int]]:
    """The k vectors whose ids hash smallest, in that order."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r["v"]) for r in vectors.select(rank.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, k: int = K, rounds: int = ROUNDS,
            scale: int = SCALE, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """id, cluster and distance of every kept vector, and the final centroids."""
    vectors = spool(integer_vectors(df, id_col, vec_col, dims, scale), "bisector-vectors")
    id_type = vectors.schema["id"].dataType.simpleString()
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids)

    def run(batches):
        meet = Tournament(centroids)
        for b in batches:
            v = _rows(b)
            if len(v):
                won = meet.winners(v)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(won.astype(np.int32)), pa.array(meet.distances(v, won))], ["id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"id {id_type}, cluster int, distance long"), centroids


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op12_bisector_clusters(spark, sf_dir):
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept vector of embeddings."""
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = spool(found, "bisector-clusters")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most K
    per = [(int(sums.get(i, 0)), centroid_digest(c)) for i, c in enumerate(centroids)] or [(0, "")]
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance", F.get(F.lit([s for s, _ in per]).cast("array<long>"), F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(s for s, _ in per)).cast("long").alias("inertia"), F.get(F.lit([h for _, h in per]), F.col("cluster")).alias("centroid_sha256"))


_ASSIGN = """
  SELECT rid, cluster, distance FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) AS nth FROM (
    SELECT k.rid, c.cluster, CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance
    FROM kept k, c{n} c) d) e WHERE nth = 1"""
_UPDATE = """
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY dim) AS v FROM (
      SELECT a.cluster, u.dim, sum(k.v[u.dim])::BIGINT AS s, count(*) AS n FROM a{n} a JOIN kept k USING (rid), (SELECT unnest(range(1, 65)) AS dim) u
      GROUP BY a.cluster, u.dim) x GROUP BY cluster) m USING (cluster)"""

ORACLE_SQL = """
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) - 1 AS cluster, v FROM kept QUALIFY cluster < 16),
""" + "".join(f"a{n} AS MATERIALIZED ({_ASSIGN.format(n=n)}),\nc{n + 1} AS MATERIALIZED ({_UPDATE.format(n=n)}),\n" for n in range(ROUNDS)) + f"""
a AS MATERIALIZED ({_ASSIGN.format(n=ROUNDS)})
SELECT k.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a JOIN kept k USING (rid) JOIN c{ROUNDS} c USING (cluster)
"""
