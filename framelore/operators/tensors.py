"""Contracts of tensors: shape, type and range of each, checked in Arrow batches, and moments that merge."""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOMENTS = (("n", "long"), ("non_finite", "long"), ("least", "double"), ("most", "double"), ("mean", "double"), ("m2", "double"))


def _values(column: pa.Array, dtype: str) -> Iterator[np.ndarray | None]:
    """Each row's numbers without a copy: of a list its values, of a binary its bytes as ``dtype``; null rows and rows with null components are None."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        size = np.dtype(dtype).itemsize
        for x in column:
            data = x.as_buffer()
            yield None if data is None or data.size % size else np.frombuffer(data, dtype)
        return
    for x in column:
        if x.values is None or x.values.null_count:
            yield None
        else:
            yield x.values.to_numpy(zero_copy_only=False)


def tensor_moments(rows: DataFrame, column: str, keys: tuple[str, ...], dtype: str = "float32") -> DataFrame:
    """keys and moments of each row's tensor (array of numbers, or binary of ``dtype`` in native order): n, non_finite, least, most, mean, m2.

    The moments are over finite values; m2 is the sum of squared deviations.  Where the tensor is null, holds null or is no whole number of
    items, n is null.  Empty tensors have n 0.  Batches of Arrow; nothing is turned into Python numbers.
    """
    fields = [rows.schema[k] for k in keys] + [T.StructField(n, T.LongType() if t == "long" else T.DoubleType()) for n, t in MOMENTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for v in _values(batch.column(len(keys)), dtype):
                if v is None:
                    out.append((None,) * 6)
                    continue
                good = v[np.isfinite(v)].astype(np.float64) if v.dtype.kind == "f" else v.astype(np.float64)
                mean = float(good.mean()) if len(good) else None
                edge = (float(good.min()), float(good.max())) if len(good) else (None, None)
                out.append((len(v), len(v) - len(good), *edge, mean, float(((good - mean) ** 2).sum()) if len(good) else None))
            new = [pa.array(list(c), pa.int64() if t == "long" else pa.float64()) for c, (_, t) in zip(zip(*out), MOMENTS)] if out else []
            if new:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *new], names=[*keys, *(n for n, _ in MOMENTS)])

    return rows.select(*keys, column).mapInArrow(run, T.StructType(fields))


def violations(moments: DataFrame, shape: tuple[int, ...], low: float | None = None, high: float | None = None, reach: tuple[float, float] | None = None) -> DataFrame:
    """moments with error, a row for each broken rule: unreadable, shape, non_finite, range, scale.

    range: values lie outside [low, high].  scale: values do not reach below reach[0] and above reach[1], as normalised ones
    should.  A tensor that can't be read has this error only.
    """
    finite = F.col("n") - F.col("non_finite") > 0
    outside = [F.col("least") < low] * (low is not None) + [F.col("most") > high] * (high is not None)
    rules = [F.when(F.col("n") != prod(shape), "shape"), F.when(F.col("non_finite") > 0, "non_finite")]
    if outside:
        rules.append(F.when(finite & (outside[0] | outside[-1]), "range"))
    if reach:
        rules.append(F.when(finite & ~((F.col("least") < reach[0]) & (F.col("most") > reach[1])), "scale"))
    errors = F.when(F.col("n").isNull(), F.array(F.lit("unreadable"))).otherwise(F.array_compact(F.array(*rules)))
    return moments.withColumn("error", F.explode(errors))


def merged(moments: DataFrame, *keys: str) -> DataFrame:
    """Moments of groups of tensors from those of each, by one aggregation and the groups' means: keys, tensors, n, non_finite, least, most, mean, std."""
    good = F.col("n") - F.col("non_finite")
    rows = moments.where("n is not null").withColumn("k", good)
    ids = [F.col(k) for k in keys]
    g = rows.groupBy(*ids).agg(
        F.count("*").alias("tensors"), F.sum("n").alias("n"), F.sum("non_finite").alias("non_finite"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.sum("k").alias("k"), F.try_divide(F.sum(F.col("mean") * F.col("k")), F.sum("k")).alias("mean"),
        # the means' own spread, by the variance of values each of which stands for k
        F.sum("m2").alias("within"), F.sum(F.col("mean") * F.col("mean") * F.col("k")).alias("squares"),
    )
    between = F.greatest(F.col("squares") - F.col("mean") * F.col("mean") * F.col("k"), F.lit(0.0))
    return g.select(*keys, "tensors", "n", "non_finite", "least", "most", "mean", F.sqrt(F.try_divide(F.col("within") + between, "k")).alias("std"))
