"""Helpers that several training-data operators share: scratch tables, words, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.  In Java and in DuckDB's RE2.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (tests).

    On a cluster a local folder would lose rows without notice, so there the setting has to be there.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = spark.conf.get("framelore.scratch.dir", None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="framelore-")
            spark.conf.set("framelore.scratch.dir", folder)
    return folder.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _live.append(path)
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table that save() wrote and that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path in _live:
        _live.remove(path)
        _delete(df.sparkSession, path)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """save() as a table bucketed by a key: tables of the same buckets meet on the key without a shuffle."""
    spark, table = df.sparkSession, f"framelore_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._scratch_path, out._scratch_table = path, table
    _live.append(path)
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table that save_bucketed() wrote and that nothing reads any more."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._scratch_table}")
    drop(df)


def free(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished jobs only once the driver's heap has been collected; have that done now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables that are written on the way to a result, deleted when the block ends; what is returned must not read them."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(save(df, name))
        return self.tables[-1]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for table in self.tables:
            drop(table)
        if self.tables:
            free(self.tables[0].sparkSession)


#: Paths of the tables that save() has written and drop() has not deleted, in order.
_live: list[str] = []


def mark() -> int:
    """A place in the order of saved tables, for drop_since()."""
    return len(_live)


def drop_since(spark: SparkSession, place: int, keep: DataFrame | None = None) -> None:
    """Delete the tables saved since mark(), but for one to keep: nothing else may read them any more."""
    for path in _live[place:]:
        if path != getattr(keep, "_scratch_path", None):
            _delete(spark, path)
    _live[place:] = [p for p in _live[place:] if p == getattr(keep, "_scratch_path", None)]
    free(spark)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: A table of ids is sent to all tasks up to so many rows and bytes; a larger one meets the texts in a shuffle.
SENT_ROWS, SENT_BYTES = 1 << 19, 1 << 24


def sent_if_small(table: DataFrame) -> DataFrame:
    """A saved table, marked for broadcast if its counted rows and bytes are within SENT_ROWS and SENT_BYTES; else as it is."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in table.columns), F.lit(0))
    rows, total = table.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(table) if rows <= SENT_ROWS and total <= SENT_BYTES else table


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


#: Edges that a task contracts at once: it bounds memory, not results.
CHUNK = 1 << 20


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (v, p) that connect what a task's edges connect: chunk by chunk each node's to the smallest it reaches."""

    def contract(parts: list[np.ndarray]) -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate(parts), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        label = np.arange(len(nodes))
        while True:
            after, least = label.copy(), np.minimum(label[a], label[b])
            np.minimum.at(after, label[a], least)
            np.minimum.at(after, label[b], least)
            after = after[after]
            if (after == label).all():
                break
            label = after
        own = np.flatnonzero(label != np.arange(len(nodes)))
        return pd.DataFrame({"v": nodes[own], "p": nodes[label[own]]})

    parts, held = [], 0
    for pdf in batches:
        parts.append(pdf[["v", "p"]].to_numpy())
        held += len(pdf)
        if held >= CHUNK:
            yield contract(parts)
            parts, held = [], 0
    if held:
        yield contract(parts)


def connected_components(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph of edges (a, b), as rows (node, root) with root the smallest node reachable.

    Large-star and small-star rounds (Kiveris et al. 2014): each halves path lengths, works on edges only, and its
    groups are reduced to a minimum before they are shuffled.  Tasks first contract the edges they hold, whatever their
    number, which leaves fewer edges and shorter paths to the rounds.  The edges of a node with very many neighbours meet in the
    joins with these minima, which adaptive execution splits.  Every round is written to the shared folder, and the last
    goes with ``scratch``, if given.  Nulls and loops are left out; no edges give no rows; edges that repeat count once.
    """
    once = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("p")).distinct()
    kind = dict(once.dtypes)["v"]
    now = save(once.mapInPandas(_forest, f"v {kind}, p {kind}").distinct(), "cc")
    mark = _fingerprint(now)
    for _ in range(max_rounds):
        both = now.select(F.col("v").alias("x"), F.col("p").alias("y")).union(now.select(F.col("p").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("p")).distinct()
        large = save(large, "cc")
        least = large.groupBy("v").agg(F.min("p").alias("m"))
        small = large.join(least, "v").where("p <> m").select(F.col("p").alias("v"), F.col("m").alias("p"))
        small = small.union(least.select("v", F.col("m").alias("p"))).distinct()
        after = save(small, "cc")
        drop(large)
        drop(now)
        now, before, mark = after, mark, _fingerprint(after)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if scratch:
        scratch.tables.append(now)
    return now.select(F.col("v").alias("node"), F.col("p").alias("root")).union(
        now.select("p", "p").distinct().toDF("node", "root")
    )


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("v", "p").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("p", "v"))).first()
    )
