"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) P(slot | class, history) P(word | slot).  Both softmaxes have hashed features of the
history: the word before (bigram), the one before that (skip) and both (trigram), besides an intercept; those of the
second are hashed with the class, too.  Weights are trained by gradient updates that tasks make on their shares of the
training rows and that are averaged after each round.  P(word | slot) is by add-one counts.  Classes: the most frequent
words one by one, the end of text, the other words of the head vocabulary by their last bytes, all further words by
their last bytes.  Each class of further words also holds its unknown words, as one.  Classes of head words have slots:
one for each of their most frequent words, the others by rank.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelore.llm.common import save
from framelore.llm.simhash import words_of

#: Classes: single words, end of text, head words by ending, further words by ending.
SINGLE, HEAD_ENDINGS, TAIL_ENDINGS = 23, 24, 16
CLASSES = SINGLE + 1 + HEAD_ENDINGS + TAIL_ENDINGS
#: The head vocabulary, sent to the tasks: at most so many words of at most so many bytes.
HEAD, LONGEST = 1 << 17, 48
#: Histories: the most frequent words, then classes of endings, then the beginning of the text.
KNOWN_HISTORY = 4096
BUCKETS, ROUNDS, RATE = 1 << 13, 3, 0.15
#: Slots of a class of head words, those that hold one word, and buckets of the second softmax.
SLOTS, OWN, INNER = 32, 24, 1 << 14
#: Tokens of one update: their scores by class fit a core's cache.
STEP = 1 << 12
END = b""
LOW = (1 << 48) - 1


def _ending(word: bytes) -> int:
    return zlib.crc32(word[-3:])


class Vocabulary:
    """The head words, most frequent first, with their counts; what tasks need to read texts."""

    def __init__(self, words: list[bytes], counts: list[int], end_count: int) -> None:
        self.ids = {w: i for i, w in enumerate(words)}
        self.words = len(words)
        self.counts = np.array([*counts, end_count], np.int64)
        ending = np.array([_ending(w) for w in words], np.int64)
        cls = np.where(np.arange(len(words)) < SINGLE, np.arange(len(words)), SINGLE + 1 + ending % HEAD_ENDINGS)
        self.cls = np.append(cls, SINGLE).astype(np.int64)
        self.log_count = np.log10(self.counts + 1.0)
        mass = np.bincount(self.cls, weights=self.counts + 1.0, minlength=CLASSES)
        self.mass = mass
        order = np.argsort(self.cls, kind="stable")
        first = np.searchsorted(self.cls[order], np.arange(CLASSES))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - first[self.cls[order]]
        self.slot = np.where(rank < OWN, rank, OWN + rank % (SLOTS - OWN))
        at = self.cls * SLOTS + self.slot
        slots = np.bincount(at, weights=self.counts + 1.0, minlength=CLASSES * SLOTS)
        self.log_in_slot = self.log_count - np.log10(np.maximum(slots[at], 1.0))
        self.slot_bias = np.log(np.maximum(slots.reshape(CLASSES, SLOTS), 1e-6) / np.maximum(mass, 1.0)[:, None]).astype(np.float32)

    def read(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        """Ids of the words and of the end; further words get -1 - their ending class, and are listed."""
        words, get = words_of(text), self.ids.get
        ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        tail = [words[i] for i in np.flatnonzero(ids < 0).tolist()]
        if tail:
            ids[ids < 0] = [-1 - _ending(w) % TAIL_ENDINGS for w in tail]
        return np.append(ids, self.words), tail

    def classes(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, self.cls[np.maximum(ids, 0)], SINGLE + HEAD_ENDINGS - ids)

    def histories(self, ids: np.ndarray, cls: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the three features of each token, 48 bits; ends: where texts end in ids."""
        code = np.where((ids >= 0) & (ids < KNOWN_HISTORY), ids, KNOWN_HISTORY + cls)
        begin, first = KNOWN_HISTORY + CLASSES, np.concatenate(([0], ends[:-1] + 1))
        one, two = np.empty_like(code), np.empty_like(code)
        one[1:], two[2:] = code[:-1], code[:-2]
        one[first], two[first] = begin, begin
        second = first + 1
        second = second[second <= ends]
        two[second] = begin
        return np.stack([(one + 1) * 0x9E3779B97 & LOW, (two + 1) * 0xC2B2AE3D27 & LOW, ((one + 1) * 8191 + two) * 0x165667B19E & LOW])

    def inside(self, cls: np.ndarray) -> np.ndarray:
        """Where tokens are of classes that have slots."""
        return np.flatnonzero((cls > SINGLE) & (cls <= SINGLE + HEAD_ENDINGS))


def outer_buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> 23) % BUCKETS


def inner_buckets(hashes: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Buckets of the features in a class."""
    mixed = ((hashes >> 11) ^ cls * 0x2545F491) * 0x9E3779B97
    return ((mixed & LOW) >> 23) % INNER


def _batches(vocabulary: Vocabulary, texts, most: int = 1 << 18):
    """Texts read in groups of about ``most`` tokens: (first text, ids, ends, words beyond the head by text)."""
    first, parts, tails, n = 0, [], [], 0
    for k, text in enumerate(texts):
        ids, tail = vocabulary.read(text)
        parts.append(ids)
        tails.append(tail)
        n += len(ids)
        if n >= most:
            yield first, np.concatenate(parts), np.cumsum([len(p) for p in parts]) - 1, tails
            first, parts, tails, n = k + 1, [], [], 0
    if parts:
        yield first, np.concatenate(parts), np.cumsum([len(p) for p in parts]) - 1, tails


def _scores(weights: np.ndarray, bias: np.ndarray, f: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Sums of the weights of each token's features and its bias, made in ``out``."""
    np.take(weights, f[0], axis=0, out=out, mode="clip")
    for row in f[1:]:
        out += np.take(weights, row, axis=0, out=spare, mode="clip")
    out += bias
    if out.size and not out.max() <= 60.0:  # far above what the weights add up to, far below overflow
        np.minimum(out, 60.0, out=out)
    return out


def _softmax(weights: np.ndarray, bias: np.ndarray, f: np.ndarray, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, own = np.empty((2, f.shape[1], weights.shape[1]), np.float32) if room is None else room[:2, : f.shape[1]]
    own = np.exp(_scores(weights, bias, f, x, own), out=own)
    return x, own, own @ np.ones(own.shape[1], np.float32)


#: Runs of so many rows or more are added up one by one, shorter ones all at once.
LONG_RUN = 12


def sums_of_runs(rows: np.ndarray, order: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs, longest first, and their sums of rows[order]; start: where runs begin.  np.add.reduceat is slow by this axis."""
    size = np.diff(np.append(start, len(order)))
    by = np.argsort(-size, kind="stable")
    first, size = start[by], size[by]
    # at_least[k]: how many runs have k rows or more
    at_least = np.searchsorted(-size, -np.arange(LONG_RUN + 1), side="right").tolist()
    long = at_least[LONG_RUN]
    total = rows.take(order[first], axis=0)
    for k in range(1, LONG_RUN - 1):
        if at_least[k + 1] == long:
            break
        total[long : at_least[k + 1]] += rows.take(order[first[long : at_least[k + 1]] + k], axis=0)
    if long:
        n = size[:long]
        end = np.cumsum(n)
        long_rows = rows.take(order[np.repeat(first[:long] - end + n, n) + np.arange(end[-1])], axis=0)
        one = np.ones(n[0], np.float32)
        for i, (at, k) in enumerate(zip((end - n).tolist(), n.tolist())):
            np.dot(one[:k], long_rows[at : at + k], out=total[i])
    return by, total


def _put(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """table[at] = rows, each row as one item."""
    item = np.dtype((np.void, table.shape[1] * table.itemsize))
    table.view(item)[:, 0][at] = rows.view(item)[:, 0]


def gradient_pass(
    weights: np.ndarray, bias: np.ndarray, squares: np.ndarray, f: np.ndarray, want: np.ndarray, rate: float, room: np.ndarray | None = None
) -> None:
    """One update (AdaGrad) in place on a batch of tokens with features f and outcomes want.

    ``room``: three tables of a row for each token, used again from batch to batch.
    """
    n, width = len(want), weights.shape[1]
    p, y, z = np.empty((3, n, width), np.float32) if room is None else room[:, :n]
    np.exp(_scores(weights, bias, f, p, y), out=p)
    p *= (1.0 / (p @ np.ones(width, np.float32)))[:, None]
    p[np.arange(n), want] -= 1.0
    for row in f:
        order = np.argsort(row.astype(np.uint16), kind="stable")
        row = row[order]
        start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        by, g = sums_of_runs(p, order, start)
        at = row[start[by]]
        total = np.take(squares, at, axis=0, out=z[: len(at)], mode="clip")
        total += np.multiply(g, g, out=y[: len(at)])
        _put(squares, at, total)
        total += 1.0
        g /= np.sqrt(total, out=total)
        g *= np.float32(rate)
        moved = np.take(weights, at, axis=0, out=y[: len(at)], mode="clip")
        moved -= g
        _put(weights, at, moved)


class Weights:
    """Both softmaxes: a row for each bucket, and intercepts (by class for the second)."""

    def __init__(self, outer: np.ndarray, inner: np.ndarray, bias: np.ndarray, slot_bias: np.ndarray) -> None:
        self.outer, self.inner, self.bias, self.slot_bias = outer, inner, bias, slot_bias

    def flat(self) -> np.ndarray:
        return np.concatenate([self.outer.ravel(), self.inner.ravel()])

    def moved(self, change: np.ndarray) -> Weights:
        n = self.outer.size
        return Weights(self.outer + change[:n].reshape(self.outer.shape), self.inner + change[n:].reshape(self.inner.shape), self.bias, self.slot_bias)

    def rooms(self) -> tuple[np.ndarray, np.ndarray]:
        """What updates need of memory."""
        return np.empty((3, STEP, CLASSES), np.float32), np.empty((3, STEP, SLOTS), np.float32)

    def learn(self, squares: tuple[np.ndarray, np.ndarray], rooms: tuple[np.ndarray, np.ndarray], v: Vocabulary, ids: np.ndarray, ends: np.ndarray, rates: tuple[float, float]) -> None:
        """Updates in place from texts: by the classes of their tokens, and by the slots of those in classes of head words."""
        cls = v.classes(ids)
        hashes = v.histories(ids, cls, ends)
        f = outer_buckets(hashes)
        for i in range(0, len(ids), STEP):
            gradient_pass(self.outer, self.bias, squares[0], f[:, i : i + STEP], cls[i : i + STEP], rates[0], rooms[0])
        at = v.inside(cls)
        f, cls, slot = inner_buckets(hashes[:, at], cls[at]), cls[at], v.slot[ids[at]]
        for i in range(0, len(at), STEP):
            gradient_pass(self.inner, self.slot_bias[cls[i : i + STEP]], squares[1], f[:, i : i + STEP], slot[i : i + STEP], rates[1], rooms[1])

    def logs(self, v: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log10 probabilities of head words and ends, and of the classes of further words."""
        cls = v.classes(ids)
        hashes = v.histories(ids, cls, ends)
        log = _log_of(self.outer, self.bias, outer_buckets(hashes), cls)
        at = v.inside(cls)
        log[at] += _log_of(self.inner, self.slot_bias[cls[at]], inner_buckets(hashes[:, at], cls[at]), v.slot[ids[at]])
        return log / np.log(10.0) + np.where(ids >= 0, v.log_in_slot[np.maximum(ids, 0)], 0.0)


def _log_of(weights: np.ndarray, bias: np.ndarray, f: np.ndarray, want: np.ndarray) -> np.ndarray:
    log, room = np.empty(len(want)), np.empty((2, min(STEP, len(want)), weights.shape[1]), np.float32)
    for i in range(0, len(want), STEP):
        x, _, total = _softmax(weights, bias if bias.ndim == 1 else bias[i : i + STEP], f[:, i : i + STEP], room)
        log[i : i + STEP] = x[np.arange(len(x)), want[i : i + STEP]] - np.log(total)
    return log


def count_words(docs: DataFrame, text_col: str = "text", most: int = 400_000) -> DataFrame:
    """Rows (word, c): how often each word occurs in docs; the empty word stands for ends of texts.  Counted before they move."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())}).astype({"n": "int64"})

        for pdf in batches:
            for text in pdf["t"]:
                counts.update(words_of(text))
                counts[END] += 1
                if len(counts) >= most:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return docs.select(F.col(text_col).alias("t")).mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _ending_class(word: Column) -> Column:
    return F.pmod(F.crc32(F.when(F.octet_length(word) > 3, F.substring(word, -3, 3)).otherwise(word)), F.lit(TAIL_ENDINGS))


class Model:
    """What training gathers: counts (a table that grows with the corpus), the head vocabulary and the class weights."""

    def __init__(self, counts: DataFrame, vocabulary: Vocabulary, tail_mass: np.ndarray, tokens: int, types: int, least: int) -> None:
        self.counts, self.vocabulary, self.tokens, self.types, self.least = counts, vocabulary, tokens, types, least
        self.log_tail_mass = np.log10(tail_mass + 1.0)
        prior = vocabulary.mass.copy()
        prior[SINGLE + 1 + HEAD_ENDINGS :] = tail_mass + 1.0
        prior = np.maximum(prior, 0.5)
        bias = np.log(prior / prior.sum()).astype(np.float32)
        self.weights = Weights(np.zeros((BUCKETS, CLASSES), np.float32), np.zeros((INNER, SLOTS), np.float32), bias, vocabulary.slot_bias)


def mean_change(tokens: pd.Series, changes: pd.Series, kind: type) -> np.ndarray:
    """Mean of changes, numbers of a kind as bytes, weighed by the tokens they come from; summed in double precision, as sums are far beyond half's range."""
    total = np.zeros(len(changes.iloc[0]) // np.dtype(kind).itemsize)
    for n, c in zip(tokens, changes):
        total += np.frombuffer(c, kind).astype(np.float64) * n
    return (total / tokens.sum()).astype(np.float32)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, rate: float = RATE, head: int = HEAD) -> Model:
    """A model of all rows of docs.  Each row is in one of ``rounds`` rounds; null text is an empty text.

    Ids may be null or repeat: each row counts.  Of an empty table the model knows no word: all texts get the intercepts.
    Texts may be of any length, their words too: words of more than ``LONGEST`` bytes are further words.
    """
    spark = docs.sparkSession
    counts = save(count_words(docs, text_col), "counts")
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    short = (F.octet_length("word") <= LONGEST) & (F.octet_length("word") > 0)
    # the least count of head words by a histogram of counts: at most 64 * 8 rows whatever the corpus
    level = F.floor(F.log2("c") * 8)
    seen, cut = 0, None
    for row in sorted(counts.where(short).groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect(), reverse=True):
        seen += row["n"]
        if seen > head:
            break
        cut = row["least"]
    cut = cut if cut is not None else 1 << 62
    rows = sorted(((-c, bytes(w)) for w, c in counts.where(short & (F.col("c") >= cut)).collect()))
    ends = counts.where(F.octet_length("word") == 0).first()
    vocabulary = Vocabulary([w for _, w in rows], [-c for c, _ in rows], ends["c"] if ends else 0)
    tail = counts.where((F.octet_length("word") > 0) & ~(short & (F.col("c") >= cut)))
    mass = np.zeros(TAIL_ENDINGS)
    for k, m in tail.groupBy(_ending_class(F.col("word"))).agg(F.sum(F.col("c") + 1)).collect():
        mass[k] = m
    model = Model(tail, vocabulary, mass, tokens, types, cut)
    words = spark.sparkContext.broadcast(vocabulary)
    part = docs.select(F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(7 * rounds)).alias("k"), F.col(text_col).alias("t"))
    chunks, adders = 64, 8
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(model.weights)

        def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            start, v, n = sent.value, words.value, 0
            mine = Weights(start.outer.copy(), start.inner.copy(), start.bias, start.slot_bias)
            squares, rooms = (np.zeros_like(start.outer), np.zeros_like(start.inner)), start.rooms()
            for pdf in batches:
                for _, ids, ends, _ in _batches(v, pdf["t"]):
                    mine.learn(squares, rooms, v, ids, ends, (rate, rate))
                    n += len(ids)
            if n:
                change = (mine.flat() - start.flat()).astype(np.float16).reshape(chunks, -1)
                adder = TaskContext.get().partitionId() % adders
                yield pd.DataFrame({"chunk": range(chunks), "adder": adder, "n": n, "change": [c.tobytes() for c in change]})

        def mean(key: tuple, pdf: pd.DataFrame, kind: type) -> pd.DataFrame:
            return pd.DataFrame({"chunk": [key[0]], "n": [int(pdf["n"].sum())], "change": [mean_change(pdf["n"], pdf["change"], kind).tobytes()]})

        mine = part.where(F.floor(F.col("k") / 7) == k).select("t")
        changes = mine.mapInPandas(learn, "chunk int, adder int, n long, change binary")
        # averaged in two steps, so that nobody gets what all tasks learned; tasks send half precision
        sums = "chunk int, n long, change binary"
        some = changes.groupBy("chunk", "adder").applyInPandas(lambda key, pdf: mean(key, pdf, np.float16), sums)
        whole = some.groupBy("chunk").applyInPandas(lambda key, pdf: mean(key, pdf, np.float32), sums)
        got = {r["chunk"]: np.frombuffer(r["change"], np.float32) for r in whole.collect()}
        if got:
            model.weights = model.weights.moved(np.concatenate([got[c] for c in range(chunks)]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_tokens, n_known, train_tokens, base_score, score.

    base_score: log10 probability by add-one word counts; score: by the model.  Null text is empty: its end alone.
    Head words are scored in the tasks that read the texts; further words are joined with the counts, each once for a
    text.  Ids may be null or repeat.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    v, tail_mass = model.vocabulary, model.log_tail_mass
    sent = spark.sparkContext.broadcast((v, model.weights, tail_mass))
    kind = dict(docs.dtypes)[id_col]  # ids go as text: pandas would make floating point numbers of them beside a null

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, weights, tail_mass = sent.value
        task, seq = TaskContext.get().partitionId(), 0
        for pdf in batches:
            for first, ids, ends, tails in _batches(v, pdf["t"]):
                log, head, at = weights.logs(v, ids, ends), ids >= 0, np.maximum(ids, 0)
                log -= np.where(head, 0.0, tail_mass[np.minimum(-1 - ids, TAIL_ENDINGS - 1) * ~head])
                begin = np.concatenate(([0], ends[:-1] + 1))
                add = lambda x: np.add.reduceat(x, begin)
                n = len(ends)
                many = [Counter(t) for t in tails]
                yield pd.DataFrame({
                    "rid": (task << 36) + seq + np.arange(n), "id": pdf["id"].iloc[first : first + n].to_numpy(), "n_tokens": ends - begin + 1,
                    "known": add((head & (v.counts[at] > 0)).astype(np.int64)), "base": add(np.where(head, v.log_count[at], 0.0)), "score": add(log),
                    "tail": [list(c.keys()) for c in many], "times": [list(c.values()) for c in many],
                })
                seq += n

    part = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    schema = "rid long, id string, n_tokens long, known long, base double, score double, tail array<binary>, times array<int>"
    read = save(part.mapInPandas(run, schema), "scored")
    tail = read.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("rid", F.col("x.tail").alias("word"), F.col("x.times").alias("n"))
    more = tail.join(model.counts, "word").groupBy("rid").agg(F.sum("n").alias("known_more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log_more"))
    out = read.drop("tail", "times").join(more, "rid", "left")
    log_more = F.coalesce("log_more", F.lit(0.0))
    return out.select(
        F.col("id").cast(kind).alias(id_col), "n_tokens", (F.col("known") + F.coalesce("known_more", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log_more - F.col("n_tokens") * float(np.log10(model.tokens + model.types + 1.0))).alias("base_score"), (F.col("score") + log_more).alias("score"),
    )
