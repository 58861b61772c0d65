"""Embedding near-duplicates by a pivot-permutation index.

Every vector is described by the permutation of its nearest reference points: its ``prefix`` nearest pivots, by directions
from the mean of the sample, so that vectors of a narrow cone are told apart.  Vectors that share at least ``shared`` pivots are candidates.  The inverted lists are those of sets of ``shared`` pivots: a vector is in
the list of each such set of its prefix, so that the vectors of a list share enough pivots, and lists are short.  A pair is
verified by cosine in the list of the first pivots that both have, and only there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelore.llm.common import Scratch, connected_components, save

COSINE, PREFIX, SHARED, LEAST_PIVOTS, MOST_PIVOTS = 0.95, 6, 2, 512, 8192
#: Vectors of a list that a task compares with as many others; about how many vectors of short lists a task's group has.
BLOCK, GROUP = 2048, 16384
#: Least recall of trial pairs; how many vectors of the sample are tried; lists of a vector; how many comparisons its copy in a list costs.
RECALL, TRIALS, MOST_LISTS, MOVE = 0.97, 2048, 560, 300
#: Long lists are joined by sending them, up to so many.
FEW_LISTS = 100_000


def choose_pivots(sample: np.ndarray, count: int, spreads: tuple[float, ...] = (0.7, 0.9)) -> np.ndarray:
    """Pivots from a sample of unit vectors: first those that lie apart, none nearer than the first spread to another, so that
    a dense group has one; where these are fewer than ``count``, nearer ones after them, as far as the last spread."""
    chosen = np.zeros((0, sample.shape[1]))
    for spread in spreads:
        for start in range(0, len(sample), 256):
            if len(chosen) == count:
                return chosen
            part = sample[start : start + 256]
            part = part[(part @ chosen.T).max(axis=1, initial=-2.0) < spread]
            fresh: list[np.ndarray] = []
            for v in part:
                if not fresh or (np.array(fresh) @ v).max() < spread:
                    fresh.append(v)
            chosen = np.concatenate([chosen, np.array(fresh).reshape(-1, sample.shape[1])])[:count]
    return chosen


def centred(unit: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Directions of unit vectors from the mean, which tell vectors of a narrow cone apart; a vector at the mean stays."""
    away = unit - mean
    length = np.linalg.norm(away, axis=1, keepdims=True)
    return np.where(length > 1e-9, away / np.maximum(length, 1e-9), unit)


def nearest(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Row by row the numbers of the ``prefix`` nearest pivots, ascending; fewer columns where there are fewer pivots."""
    out = np.zeros((len(vectors), min(prefix, len(pivots))), np.int32)
    for i in range(0, len(vectors), 4096):
        near = -(vectors[i : i + 4096] @ pivots.T)
        part = np.argpartition(near, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] < len(pivots) else np.tile(np.arange(len(pivots)), (len(near), 1))
        out[i : i + 4096] = np.sort(part, axis=1)
    return out


def list_keys(near: np.ndarray, shared: int) -> np.ndarray:
    """Keys of the lists that vectors are in: one for each set of ``shared`` pivots, 16 bits for each pivot."""
    sets = [sum(near[:, p].astype(np.int64) << 16 * (shared - 1 - k) for k, p in enumerate(c)) for c in combinations(range(near.shape[1]), shared)]
    return np.stack(sets, axis=1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(float)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def trial_pairs(unit: np.ndarray, mean: np.ndarray, cosine: float, most: int = TRIALS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs that an index of these vectors has to find: those among the first ``most`` vectors, and each of them beside one
    that lies ``cosine`` from it and as far from the mean, in the direction of another vector."""
    v = unit[:most]
    a, b = np.nonzero(np.triu(v @ v.T >= cosine, 1))
    some = np.linspace(0, max(len(a) - 1, 0), min(len(a), 4 * most)).astype(int)
    away = v - mean
    square = np.maximum((away * away).sum(1, keepdims=True), 1e-18)
    kept = 1 - (1 - cosine) / square
    other = np.roll(away, 1, axis=0)
    across = other - (away * other).sum(1, keepdims=True) / square * away
    length = np.linalg.norm(across, axis=1, keepdims=True)
    apart = ((kept > 0) & (length > 1e-9))[:, 0]
    moved = mean + kept * away + np.sqrt(np.maximum((1 - kept**2) * square, 0)) * across / np.maximum(length, 1e-9)
    return [(v[a[some]], v[b[some]]), (v[apart], _unit(moved[apart]))]


def fit_index(unit: np.ndarray, wanted: int, count: int, cosine: float, prefix: int, shared: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Mean, pivots, prefix and shared count from a sample of unit vectors, so that trial pairs are found with recall ``RECALL``.

    What is given is taken if it finds them.  Else longer prefixes, three shared pivots and fewer pivots are tried, and the
    cheapest index that finds them is taken: by the comparisons of ``count`` vectors in the lists, and by the lists of each.
    Where none is cheaper than a single list, all vectors are in that, and everything is found.
    """
    mean = unit.mean(axis=0)
    points = choose_pivots(centred(unit, mean), wanted)
    trials = [(centred(a, mean), centred(b, mean)) for a, b in trial_pairs(unit, mean, cosine) if len(a)]
    some = centred(unit[:TRIALS], mean)

    def found(points: np.ndarray, p: int, s: int) -> bool:
        return all(((nearest(a, points, p)[:, :, None] == nearest(b, points, p)[:, None, :]).any(2).sum(1) >= s).mean() >= RECALL for a, b in trials)

    if len(points) <= prefix or shared > 3 or found(points, prefix, shared):
        return mean, points, prefix, shared
    best = (float(count), points[:1], 1, 1)  # all vectors in one list
    while len(points) > prefix:
        for p in (prefix, 8, 12, 16, 24):
            if p < prefix or p > len(points) // 2:
                continue
            for s in (2, 3):
                if comb(p, s) <= MOST_LISTS and found(points, p, s):
                    n = np.unique(list_keys(nearest(some, points, p), s), return_counts=True)[1].astype(float)
                    cost = count * (n * (n - 1)).sum() / max(len(some) * (len(some) - 1), 1) + MOVE * comb(p, s)
                    best = min(best, (cost, points, p, s), key=lambda x: x[0])
        points = points[: len(points) // 2]
    return mean, *best[1:]


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, prefix: int = PREFIX,
    shared: int = SHARED, pivots: int | None = None,
) -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept.

    n_links: other rows whose cosine is ``cosine`` or more, of those that the index finds; rows of the same vector all
    link.  component_id: smallest id reachable.  kept: the row's id is component_id.  Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing; nor do vectors of different lengths.  A null id is never a
    component's smallest unless there is no other, and such a row is not kept.  Links are counted where they are found and never
    written out as pairs.  ``pivots``: by default the square root of the number of distinct vectors, doubled,
    512 to 8192, from a sample of four times as many vectors, the first by a hash; every vector is indexed.  ``prefix``
    and ``shared`` are kept if pairs made from the sample are found with recall 0.97, else fitted (``fit_index``).  Only these
    columns are read, so others may have any names.  An empty table gives an empty result.
    """
    v, single = F.col("v"), dict(vectors.dtypes)[vector_col] == "array<float>"
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    base = vectors.select(vectors[f"`{id_col}`"].alias("id"), vectors[f"`{vector_col}`"].cast("array<float>" if single else "array<double>").alias("v"))
    rows = base.withColumn("fine", F.coalesce(fine, F.lit(False)))
    with Scratch() as scratch:
        # equal vectors are one class, counted before they move
        classes = rows.where("fine").groupBy("v").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
        classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("uid"), "v", "copies", "least"), "vectors")
        found = []
        for dim, count in classes.groupBy(F.size("v")).count().collect():
            found.append(_search(classes.where(F.size("v") == dim), count, cosine, prefix, shared, pivots, single, scratch))
        schema = "uid long, links long, root long"
        links = scratch.save(reduce(DataFrame.unionAll, found), "links") if found else vectors.sparkSession.createDataFrame([], schema)
        roots = connected_components(links.select(F.col("uid").alias("a"), F.col("root").alias("b")), scratch)
        counts = links.groupBy("uid").agg(F.sum("links").alias("links"))
        named = classes.join(roots, classes["uid"] == roots["node"], "left").select("uid", "v", "copies", "least", F.coalesce("root", "uid").alias("root"))
        least = named.groupBy("root").agg(F.min("least").alias("component_id"))
        named = named.join(least, "root").join(counts, "uid", "left")
        named = save(named.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "named")
    known = rows.where("fine").join(named, "v").select("id", "n_links", "component_id")
    lone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = known.unionAll(lone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _search(classes: DataFrame, count: int, cosine: float, prefix: int, shared: int, pivots: int | None, single: bool, scratch: Scratch) -> DataFrame:
    """Rows (uid, links, root) for vectors of one length: links found at a list, and the smallest uid that they reach there."""
    spark, kind = classes.sparkSession, np.float32 if single else np.float64
    wanted = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 * isqrt(count)))
    sample = classes.orderBy(F.xxhash64("v"), "v").limit(4 * wanted).select("v").toPandas()
    mean, points, prefix, shared = fit_index(_unit(np.array(sample["v"].tolist())), wanted, count, cosine, prefix, shared)
    shared = min(shared, len(points), prefix)
    sent = spark.sparkContext.broadcast((mean, points))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.array(pdf["v"].tolist(), kind)
                mean, points = sent.value
                near = nearest(centred(_unit(v), mean), points, prefix)
                yield pd.DataFrame({"uid": pdf["uid"], "copies": pdf["copies"], "vector": [x.tobytes() for x in v], "near": list(near), "keys": list(list_keys(near, shared))})

    described = classes.select("uid", "copies", "v").mapInPandas(describe, "uid long, copies long, vector binary, near array<int>, keys array<long>")
    described = scratch.save(described, "prefixes")
    # a long list is cut into blocks, each pair of which is a group of its own; short lists go together
    in_lists = described.select("uid", F.explode("keys").alias("key"))
    long_ = scratch.save(in_lists.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("many")), "long")
    n_long, mine = long_.count(), F.lit(None).cast("map<bigint,int>")
    if n_long:
        held = in_lists.join(F.broadcast(long_) if n_long <= FEW_LISTS else long_, "key").groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("key", "many"))).alias("lists"))
        described, mine = described.join(held, "uid", "left"), F.col("lists")
    many = F.coalesce(F.try_element_at(mine, F.col("key")), F.lit(1))
    dealt = described.withColumn("lists", mine).select("uid", "copies", "vector", "near", F.explode("keys").alias("key"), "lists")
    dealt = dealt.withColumn("many", many).withColumn("mine", F.pmod(F.xxhash64("uid"), F.col("many")).cast("int")).drop("lists")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    groups = max(64, count * comb(prefix, shared) // GROUP)
    group = F.when(F.col("many") > 1, F.col("key") + (1 << 62)).otherwise(F.pmod(F.xxhash64("key"), F.lit(groups)))
    dealt = dealt.select(group.alias("group"), F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "key", "mine", "uid", "copies", "vector", "near")

    def compare(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, one, two = group
        pdf = pdf.sort_values(["key", "uid"])
        key, uid, copies, mine = (pdf[c].to_numpy(np.int64) for c in ("key", "uid", "copies", "mine"))
        unit = _unit(np.frombuffer(b"".join(pdf["vector"]), kind).reshape(len(pdf), -1))
        near = np.array(pdf["near"].tolist(), np.int64)
        pairs = [np.zeros((2, 0), np.int64)]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        end = np.r_[begin[1:], len(key)]
        for lo, hi in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist()):
            left, right = lo + np.flatnonzero(mine[lo:hi] == one), lo + np.flatnonzero(mine[lo:hi] == two)
            for i in range(0, len(left), 512):
                part = left[i : i + 512]
                a, b = np.nonzero(unit[part] @ unit[right].T >= cosine)
                a, b = part[a], right[b]
                if one == two:
                    a, b = a[a < b], b[a < b]
                for j in range(0, len(a), 1 << 16):
                    x, y = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
                    both = (near[x][:, :, None] == near[y][:, None, :]).any(2)
                    # counted in the list of the first pivots that both have, and only there
                    place = np.where(both, np.cumsum(both, axis=1), 0)
                    first = sum(((near[x] * (place == k)).sum(1) << 16 * (shared - k)) for k in range(1, shared + 1))
                    own = first == key[lo]
                    pairs.append(np.stack([x[own], y[own]]))
        x, y = np.concatenate(pairs, axis=1)
        nodes, node = np.unique(uid, return_inverse=True)
        links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        np.add.at(links, node[x], copies[y])
        np.add.at(links, node[y], copies[x])
        while True:
            low, before = np.minimum(root[node[x]], root[node[y]]), root.copy()
            np.minimum.at(root, before[node[x]], low)
            np.minimum.at(root, before[node[y]], low)
            root = root[root]
            if (root == before).all():
                break
        on = links > 0
        return pd.DataFrame({"uid": nodes[on], "links": links[on], "root": nodes[root[on]]})

    return dealt.groupBy("group", "one", "two").applyInPandas(compare, "uid long, links long, root long")
