"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelore.llm.common import drop, save

#: Words and runs of other signs are tokens of their own.
TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]+")
BITS, ALPHA, BETA, L1, L2, EPOCHS, SHARDS = 18, 2.0, 1.0, 0.0, 0.0, 3, 4
#: At most so many labelled rows are used to fit, the first by a hash of their ids.
MOST_LABELLED = 20_000
#: Buckets in a piece: states move between tasks, and weights to the driver, piece by piece.
PIECE = 1 << 12
STATE = "piece int, z binary, n binary"


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of the tokens and token pairs of the whole text: square roots of counts, of length one.

    A text without tokens has the one feature "no text", bucket 0.
    """
    tokens = TOKEN.findall((text or "").encode("utf-8", "surrogatepass"))
    if not tokens:
        return np.zeros(1, np.int64), np.ones(1)
    h = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    pairs = h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(0x85EBCA77)
    pairs ^= pairs >> np.uint64(29)
    index, count = np.unique(np.concatenate((h, pairs)) & np.uint64((1 << bits) - 1), return_counts=True)
    value = np.sqrt(count)
    return index.astype(np.int64), value / np.sqrt(value @ value)


class FTRL:
    """State of the updates; the last place is the intercept."""

    def __init__(self, z: np.ndarray, n: np.ndarray, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = z, n, alpha, beta, l1, l2

    def weights(self, i=slice(None)) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def update(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        g = (sigmoid(w @ value) - label) * value
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] += g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    bits: int = BITS, epochs: int = EPOCHS, shards: int = SHARDS, most: int = MOST_LABELLED,
) -> np.ndarray:
    """Weights (2^bits buckets and the intercept) fitted on the labelled rows, at most ``most`` of them.

    Each epoch runs the updates on ``shards`` shards of the sample in parallel, from a common state, and averages the
    states.  States go from task to task as tables of pieces; only the weights come to the driver, once.  Labels that are
    null or neither 0 nor 1, and labels without a document, are not used; rows that repeat are used as often.  Without
    any, all weights are zero and every score is a half.
    """
    spark, size = docs.sparkSession, (1 << bits) + 1
    picked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__i"), F.col(label_col).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("__i"), "__i", "y").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(picked), F.col("id") == F.col("__i"))

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fs = [features(t, bits) for t in pdf["t"]]
            shard = [zlib.crc32(str(i).encode()) % shards for i in pdf["id"]]
            yield pd.DataFrame({"shard": shard, "id": pdf["id"], "y": pdf["y"], "i": [i.astype(np.int32).tobytes() for i, _ in fs], "v": [v.astype(np.float32).tobytes() for _, v in fs]})

    kind = dict(docs.dtypes)[id_col]
    sample = save(rows.mapInPandas(sparse, f"shard int, id {kind}, y int, i binary, v binary"), "sample")
    state = spark.createDataFrame([], STATE)

    def learn_in(epoch: int):
        def learn(key: tuple, pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            if pdf.empty:  # a shard without rows has no state
                return pd.DataFrame({"piece": [], "shard": [], "z": [], "n": []})
            model = FTRL(_joined(state["piece"], state["z"], size), _joined(state["piece"], state["n"], size))
            pdf = pdf.sort_values(["id", "y"])
            for k in np.random.default_rng([epoch, key[0]]).permutation(len(pdf)):
                row = pdf.iloc[k]
                index = np.append(np.frombuffer(row["i"], np.int32), size - 1)
                model.update(index, np.append(np.frombuffer(row["v"], np.float32).astype(float), 1.0), int(row["y"]))
            cut = range(0, size, PIECE)
            z, n = ([x[i : i + PIECE].tobytes() for i in cut] for x in (model.z, model.n))
            return pd.DataFrame({"piece": range(len(cut)), "shard": key[0], "z": z, "n": n})

        return learn

    for epoch in range(epochs):
        common = state.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        states = sample.groupBy("shard").cogroup(common.groupBy("shard")).applyInPandas(learn_in(epoch), f"shard int, {STATE}")
        after = save(states.groupBy("piece").applyInPandas(_mean_state, STATE), "state")
        drop(state)
        state = after

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w = [FTRL(np.frombuffer(z), np.frombuffer(n)).weights().tobytes() for z, n in zip(pdf["z"], pdf["n"])]
            yield pd.DataFrame({"piece": pdf["piece"], "w": w})

    found = state.mapInPandas(weigh, "piece int, w binary").collect()
    drop(state)
    drop(sample)
    return _joined([r["piece"] for r in found], [r["w"] for r in found], size)


def _joined(pieces: Iterable[int], values: Iterable[bytes], size: int) -> np.ndarray:
    """The whole array of these pieces; zero where there is none."""
    out = np.zeros(size)
    for k, x in zip(pieces, values):
        out[k * PIECE : (k + 1) * PIECE] = np.frombuffer(x)
    return out


def _mean_state(pdf: pd.DataFrame) -> pd.DataFrame:
    """The mean of the shards' states of a piece, added in the order of the shards."""
    pdf = pdf.sort_values("shard")
    z, n = (np.mean([np.frombuffer(x) for x in pdf[k]], axis=0).tobytes() for k in ("z", "n"))
    return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "z": [z], "n": [n]})


def scored(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> Column:
    """The score of a text, as a column: a sparse dot product through the logistic function.

    Null and empty texts get the score of "no text".
    """
    sent, bits = docs.sparkSession.sparkContext.broadcast(weights), (len(weights) - 1).bit_length() - 1

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        w = sent.value
        return pd.Series(sigmoid(np.array([w[i] @ v + w[-1] for i, v in (features(t, bits) for t in texts)], float)))

    return run(docs[f"`{text_col}`"])


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, score) for every row of docs; ids may be null or repeat."""
    return docs.select(docs[f"`{id_col}`"], scored(docs, weights, text_col).alias("score"))


def keep_good(docs: DataFrame, weights: np.ndarray, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is ``least`` or more, columns as they are."""
    return docs.where(scored(docs, weights, text_col) >= least)
