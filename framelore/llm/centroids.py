"""Centroid clustering by delta Lloyd rounds, exact in integers.

Vectors lie in a table bucketed by row; assignments lie in another of the same buckets, so that each round joins the two
without a shuffle and writes assignments only.  A round compares a vector with the centroids that changed, and with all of
them only where its own one changed.  Vectors that change owner are added up in their task as signed integers, which are
stored beside the assignments; the global sums move by these transfers, and centroids are floors of sums by counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelore.llm.common import Scratch, drop_table, save_bucketed

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SALT = 8, 10, 64, 1024, "3"
#: Components of this magnitude or more would give squared distances beyond 64 bits.
BOUND = 2.0**17
#: Components that a bucket of vectors holds, about.
BUCKET = 1 << 25
#: Up to this magnitude, products of 64 components are exact as doubles.
EXACT = 1 << 22
LARGEST = 2**63 - 1
STATE = "uid long, cluster int, distance long, transfer array<long>"


@dataclass
class Clusters:
    """assigned: (uid, id, cluster, distance), one row per kept vector.  centroids: lists of integers.  rounds: passes made."""

    assigned: DataFrame
    centroids: list[list[int]]
    rounds: int


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows of v and c, exact in 64 bits; by floating point where that is exact too."""
    if not len(v) or not len(c):
        return np.zeros((len(v), len(c)), np.int64)
    if max(np.abs(v).max(), np.abs(c).max()) * max(1.0, v.shape[1] / 64) <= EXACT:
        cross = (v.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
        return (v * v).sum(1)[:, None] - 2 * cross + (c * c).sum(1)[None, :]
    return np.stack([((v - x) ** 2).sum(1) for x in c], axis=1)


def reassign(v: np.ndarray, c: np.ndarray, changed: np.ndarray, owner: np.ndarray | None, held: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroids and squared distances; ties go to the smaller number.

    owner, held: what the last pass found (None at first).  Rows whose owner did not change meet the changed centroids only.
    """
    if owner is None:
        all_ = distances(v, c)
        now = all_.argmin(1)
        return now, all_[np.arange(len(v)), now]
    now, best = owner.copy(), held.copy()
    lost, few = changed[owner], np.flatnonzero(changed)
    full = distances(v[lost], c)
    now[lost] = full.argmin(1)
    best[lost] = full[np.arange(len(full)), now[lost]]
    kept = np.flatnonzero(~lost)
    if len(few) and len(kept):
        some = distances(v[kept], c[few])
        near = some.argmin(1)
        d, number = some[np.arange(len(kept)), near], few[near]
        wins = (d < best[kept]) | ((d == best[kept]) & (number < now[kept]))
        now[kept[wins]], best[kept[wins]] = number[wins], d[wins]
    return now, best


def _pass(c: np.ndarray, changed: np.ndarray, first: bool):
    """Batches of (uid, v[, cluster, distance]) to rows of STATE: assignments, then the task's signed transfers by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, uid = np.zeros((len(c), c.shape[1] + 1), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, c.shape[1])
            owner = None if first else batch.column("cluster").to_numpy().astype(np.int64)
            held = None if first else batch.column("distance").to_numpy()
            now, best = reassign(v, c, changed, owner, held)
            one = np.concatenate([np.ones((len(v), 1), np.int64), v], axis=1)
            moved = np.full(len(v), True) if first else now != owner
            np.add.at(sums, now[moved], one[moved])
            if not first:
                np.subtract.at(sums, owner[moved], one[moved])
            uid = batch.column("uid")[0].as_py()
            none = pa.nulls(len(v), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(now.astype(np.int32)), pa.array(best), none], names=["uid", "cluster", "distance", "transfer"])
        some = np.flatnonzero(sums.any(1))
        if len(some):  # under a uid of this bucket, so that they stay in its file
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array([uid] * n, pa.int64()), pa.array(some.astype(np.int32)), pa.nulls(n, pa.int64()), pa.array(list(sums[some]), pa.list_(pa.int64()))],
                names=["uid", "cluster", "distance", "transfer"],
            )

    return run


def lloyd(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS, scale: int = SCALE, salt: str = SALT,
) -> Clusters:
    """Vectors assigned to the nearest of ``clusters`` centroids after ``rounds`` rounds of Lloyd's algorithm in integers.

    Kept are vectors of exactly ``dimensions`` components, none null, NaN, infinite or of magnitude 2^17 and more (their
    distances would not fit 64 bits); components become floor(scale * x).  Null, empty, shorter and longer vectors give no
    row.  Centroids start as the kept vectors with the smallest SHA-256 of "salt:id" (a null id as empty text; ties by the vector), fewer if
    fewer are kept.  Ties of distance go to the smaller number.  A centroid becomes the floor of its vectors' sum by their
    count; one without vectors stays.  Repeated rows count each.  Rounds end early where no centroid changes, as no later
    round would do anything.  Only the two columns are read, so others may have any names.  An empty table: no rows and no centroids.
    Centroids and sums (clusters * dimensions numbers) are all that the driver holds.
    """
    spark, x = vectors.sparkSession, F.col("v")
    rows = vectors.select(vectors[f"`{id_col}`"].alias("id"), vectors[f"`{vector_col}`"].cast("array<double>").alias("v"))
    fine = x.isNotNull() & (F.size(x) == dimensions) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < BOUND))
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "id", F.transform(x, lambda y: F.floor(y * float(scale)).cast("int")).alias("v"))
    with Scratch() as scratch:
        numbered = scratch.save(rows, "vectors")  # numbers are fixed before rows are dealt by them
        order = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
        seeds = [r["v"] for r in numbered.select("v", order.alias("h")).orderBy("h", "v").limit(clusters).collect()]
        buckets = max(spark.sparkContext.defaultParallelism, -(-numbered.count() * dimensions // BUCKET))
        table = save_bucketed(numbered.repartition(buckets, "uid"), "vectors", "uid", buckets)
    c = [list(map(int, s)) for s in seeds]
    if not c:
        return Clusters(table.select("uid", "id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), [], 0)
    count, total = [0] * len(c), [[0] * dimensions for _ in c]
    changed, state, passes = np.full(len(c), True), None, 0
    while True:
        known = table.select("uid", "v")
        if state is not None:
            known = known.join(state.where("distance is not null").select("uid", "cluster", "distance").hint("merge"), "uid")
        after = save_bucketed(known.mapInArrow(_pass(np.array(c, np.int64), changed, state is None), STATE), "assigned", "uid", buckets)
        if state is not None:
            drop_table(state)
        state, passes = after, passes + 1
        if passes > rounds:
            break
        for k, place, amount in _transfers(state):
            if place:
                total[k][place - 1] += amount
            else:
                count[k] += amount
        new = [[s // n for s in total[k]] if n else c[k] for k, n in enumerate(count)]
        changed, c = np.array([a != b for a, b in zip(new, c)]), new
        if not changed.any():
            break
    assigned = table.select("uid", "id").join(state.where("distance is not null").select("uid", "cluster", "distance").hint("merge"), "uid")
    return Clusters(assigned, c, passes)


def _transfers(state: DataFrame) -> list[tuple[int, int, int]]:
    """(cluster, place, amount) over all tasks: place 0 is the count, the others are components."""
    moved = state.where("transfer is not null").select("cluster", F.posexplode("transfer").alias("place", "amount"))
    sums = moved.groupBy("cluster", "place").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))
    return [(r["cluster"], r["place"], int(r["amount"])) for r in sums.collect()]


def digest(found: Clusters, spark: SparkSession, id_col: str = "vec_id") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) per kept vector; sums beyond a long are its largest value."""
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    sums = found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect() if found.centroids else []
    by = {r["cluster"]: int(r["s"]) for r in sums}
    whole = min(sum(by.values()), LARGEST)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    of = spark.createDataFrame([(k, min(s, LARGEST), whole, sha[k]) for k, s in by.items()], schema)  # a row per cluster
    out = found.assigned.join(F.broadcast(of), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
