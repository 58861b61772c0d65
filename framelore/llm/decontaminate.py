"""Benchmark decontamination: SimHash of item-sized windows, found through multi-index Hamming blocks, verified exactly.

For each benchmark item of n words, every window of n words of a document that shares a shingle with an item of that
size gets a SimHash of its shingles, repeats included.  Its bits are cut into blocks.  An index holds every item, block
by block, under all values that differ from its own in at most ``NEAR`` bits; a window's blocks are looked up there.  Two
fingerprints of which every block differs in more than that differ in at least ``BLOCKS * (NEAR + 1)`` bits, so all
within ``RADIUS`` are found for certain, and at a similarity of 0.8 all but about two in 100,000 of those beyond it, for
one block of many is enough.  Of random pairs fewer than one in a hundred are candidates.  They are verified by weighted
Jaccard similarity: shared shingles over all, each counted as often as it occurs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelore.llm.simhash import WORD, mixed, shingle_keys, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: Blocks of a fingerprint and their bits, the bits in which a block's values are near, the radius that they guarantee.
BLOCKS, WIDTH, NEAR = 32, 16, 1
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Benchmark texts go to the tasks in blocks of about so many bytes: the bound of what is sent at once.
BLOCK_BYTES = 1 << 20
#: Windows whose bits are counted at once: it bounds memory, not results.
STEP = 2048
#: Odd multipliers of a shingle's key for each 64 bits of a fingerprint.
BITS = np.random.default_rng(8).integers(1, 1 << 63, BLOCKS * WIDTH // 64, np.uint64) * np.uint64(2) + np.uint64(1)


def key_bits(keys: np.ndarray) -> np.ndarray:
    """The bits that each key adds to a fingerprint: one row for each key."""
    with np.errstate(over="ignore"):
        wide = mixed(keys[:, None] * BITS)
    return np.unpackbits(wide.astype("<u8").view(np.uint8).reshape(len(keys), BLOCKS * WIDTH // 8), axis=1, bitorder="little")


def fingerprints(sums: np.ndarray, n: int) -> np.ndarray:
    """Blocks of fingerprints: a bit is 1 where more than half of n shingles have it."""
    return np.packbits(2 * sums > n, axis=-1, bitorder="little").view("<u2").reshape(-1, BLOCKS)


def window_fingerprints(keys: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first window, fingerprints) of all windows of ``span`` keys, part by part; sums slide from each to the next."""
    count = len(keys) - span + 1
    now = sum(key_bits(keys[i : min(i + STEP, span)]).sum(0, dtype=np.int64) for i in range(0, span, STEP))
    for i in range(0, count, STEP):
        m = min(STEP, count - i)
        gone, come = key_bits(keys[i : i + m]), key_bits(keys[i + span : i + span + m])
        change = np.zeros((m + 1, BLOCKS * WIDTH), np.int32)
        change[1 : len(come) + 1] = come
        change[1 : len(come) + 1] -= gone[: len(come)]
        sums = now + np.cumsum(change, axis=0)
        yield i, fingerprints(sums[:m], span)
        now = sums[m]


def overlaps(keys: np.ndarray, span: int, wanted: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each window of ``span`` keys how many it shares with a multiset (distinct keys in order, how often each).

    The key at a place counts for the windows that begin after its ``times``-th occurrence before it.
    """
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    place = np.flatnonzero(wanted[at] == keys)
    order = np.argsort(at[place], kind="stable")
    place, which = place[order], at[place][order]
    back = np.arange(len(place)) - times[which]
    same = (back >= 0) & (which[np.maximum(back, 0)] == which)
    first = np.maximum(np.where(same, place[np.maximum(back, 0)] + 1, 0), place - span + 1)
    change = np.zeros(len(keys) + 1, np.int64)
    np.add.at(change, np.maximum(first, 0), 1)
    np.add.at(change, place + 1, -1)
    return np.cumsum(change)[: len(keys) - span + 1]


class Index:
    """One block of the benchmark: vocabulary, shingles, and the items under the near values of their blocks."""

    def __init__(self, texts: list[tuple[str, str]], shingle: int = SHINGLE) -> None:
        self.n, self.names, self.words, self.sizes, self.wanted = shingle, [], {}, [], []
        self.short: dict[int, dict[int, int]] = defaultdict(dict)
        hashes, keys_of, marks = [], [], []
        for name, text in texts:
            words = words_of(text)
            if not words:
                continue
            for w in words:
                if w not in self.words:
                    self.words[w] = len(hashes)
                    hashes.append(xxhash.xxh64_intdigest(w))
            codes = np.array([hashes[self.words[w]] for w in words], np.uint64)
            own = len(self.names)
            self.names.append(name)
            self.sizes.append(len(words))
            if len(words) < shingle:
                self.short[len(words)][int(shingle_keys(codes, len(words))[0])] = own
                self.wanted.append(None)
                continue
            keys = shingle_keys(codes, shingle)
            self.wanted.append(np.unique(keys, return_counts=True))
            keys_of.append((own, self.wanted[-1][0]))
            sums = sum(key_bits(keys[i : i + STEP]).sum(0, dtype=np.int64) for i in range(0, len(keys), STEP))
            marks.append((own, fingerprints(sums, len(keys))[0]))
        self.hashes = np.array([*hashes, 0], np.uint64)
        # which sizes of items hold a shingle
        pairs = [np.unique(np.stack([keys, np.full(len(keys), self.sizes[own], np.uint64)], 1), axis=0) for own, keys in keys_of]
        both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.uint64)
        self.shingles, self.first = np.unique(both[:, 0], return_index=True)
        self.first, self.size_of = np.append(self.first, len(both)), both[:, 1].astype(np.int64)
        near = np.array([sum(1 << b for b in c) for c in [(), *((b,) for b in range(WIDTH))]], np.uint32)
        entries = [((np.arange(BLOCKS, dtype=np.uint32) << WIDTH | mark)[:, None] ^ near).ravel() for _, mark in marks]
        values = np.concatenate(entries) if entries else np.zeros(0, np.uint32)
        items = np.repeat(np.array([own for own, _ in marks], np.int64), BLOCKS * len(near))
        order = np.argsort(values, kind="stable")
        self.values, self.items = values[order], items[order]

    def candidates(self, fps: np.ndarray, size: int) -> np.ndarray:
        """Items of this size that a fingerprint has a near block with."""
        probe = (np.arange(BLOCKS, dtype=np.uint32) << WIDTH | fps).ravel()
        low, high = np.searchsorted(self.values, probe), np.searchsorted(self.values, probe, "right")
        some = np.flatnonzero(high > low)
        found = [np.zeros(0, np.int64)]
        for k in range(int((high - low).max(initial=0))):
            some = some[low[some] + k < high[some]]
            found.append(np.unique(self.items[low[some] + k]))
        found = np.unique(np.concatenate(found))
        return found[[self.sizes[i] == size for i in found.tolist()]] if len(found) else found

    def search(self, text: str | None, similarity: float = SIMILARITY) -> list[tuple[str, int, int, float]]:
        """(item, first word, words, similarity) of the best window for each item that the text holds, the first of equals."""
        words, n, get = words_of(text), self.n, self.words.get
        best: dict[int, tuple[float, int, int]] = {}
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        codes, ready = self.hashes[ids], ids >= 0

        def runs(k: int) -> np.ndarray:
            return np.flatnonzero(known[k:] - known[:-k] == k) if len(words) >= k else np.zeros(0, np.int64)

        def keys_at(places: np.ndarray, k: int) -> np.ndarray:
            with np.errstate(over="ignore"):
                return mixed(sum((codes[places + i] * WORD[i] for i in range(k)), np.zeros(len(places), np.uint64)))

        for k, own in self.short.items():
            places = runs(k)
            for p, key in zip(places.tolist(), keys_at(places, k).tolist()):
                if key in own:
                    best.setdefault(own[key], (1.0, p, k))
        places = runs(n)
        if len(places) and len(self.shingles):
            keys = keys_at(places, n)
            at = np.minimum(np.searchsorted(self.shingles, keys), len(self.shingles) - 1)
            hit = self.shingles[at] == keys
            places, at = places[hit], at[hit]
            count = self.first[at + 1] - self.first[at]
            where = np.repeat(places, count)
            size = self.size_of[np.repeat(self.first[at] - np.cumsum(count) + count, count) + np.arange(count.sum())] if len(at) else count
            for s in np.unique(size).tolist():
                span = min(s, len(words)) - n + 1
                for a, b in _ranges(np.unique(where[size == s]), span, len(words) - n + 1):
                    fresh = np.flatnonzero(~ready[a : b + span + n - 1]) + a
                    codes[fresh] = np.fromiter((xxhash.xxh64_intdigest(words[p]) for p in fresh.tolist()), np.uint64, len(fresh))
                    ready[fresh] = True
                    self._windows(a, s, shingle_keys(codes[a : b + span + n - 1], n), span, similarity, best)
        return [(self.names[i], start, count, sim) for i, (sim, start, count) in best.items()]

    def _windows(self, start: int, size: int, keys: np.ndarray, span: int, similarity: float, best: dict) -> None:
        """All windows of ``span`` keys, through the index, the items found there exactly."""
        found = [self.candidates(fps, size) for _, fps in window_fingerprints(keys, span)]
        for item in np.unique(np.concatenate(found)).tolist():
            wanted, times = self.wanted[item]
            both = overlaps(keys, span, wanted, times)
            w = int(both.argmax())
            sim = float(both[w] / (times.sum() + span - both[w]))
            if sim >= similarity and (item not in best or (sim, -(start + w)) > (best[item][0], -best[item][1])):
                best[item] = (sim, start + w, span + self.n - 1)


def _ranges(places: np.ndarray, span: int, total: int) -> Iterator[tuple[int, int]]:
    """First and last window of each range of windows (of ``span`` shingles of ``total``) that hold one of the places."""
    low, high = np.maximum(0, places - span + 1), np.minimum(places, total - span)
    cut = np.flatnonzero(low[1:] > high[:-1] + 1)
    yield from zip(low[np.r_[0, cut + 1]].tolist(), high[np.r_[cut, len(high) - 1]].tolist())


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows (doc_id, item_id, start_word, n_words, similarity): for each document row and item it holds, the best window.

    Of windows that are equally similar the first counts.  The benchmark is the query set: its distinct texts are cut
    into blocks of about block_bytes, and each block is sent to the tasks in turn and held against all documents, whole,
    however long.  Null and empty texts hold nothing and are no items.  An item of fewer than ``shingle`` words is one
    shingle of its own length, found wherever its words occur; a document shorter than an item is one window.  Items of
    equal texts are all reported; so are repeated document rows.  Ids may be of any type and null.  Only these columns
    are read, so others may have any names.  Empty tables give an empty result.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(f"`{item_text_col}`").isNotNull()).select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("t"))
    texts = items.select("t").distinct()
    bytes_ = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = 1 + bytes_ // block_bytes
    found = []
    for k in range(count):
        rows = [tuple(r) for r in texts.where(F.pmod(F.xxhash64("t"), F.lit(count)) == k).select(F.md5(F.col("t").cast("binary")), "t").collect()]
        if rows:
            found.append(_scan(docs, id_col, text_col, spark.sparkContext.broadcast(rows), shingle, similarity))
    names = items.select("item_id", F.md5(F.col("t").cast("binary")).alias("name"))
    if not found:
        kind, of = (next(f.dataType for f in d.schema if f.name == c) for d, c in ((docs, id_col), (benchmark, item_col)))
        return spark.createDataFrame([], f"doc_id {kind.simpleString()}, item_id {of.simpleString()}, start_word long, n_words long, similarity double")
    return reduce(DataFrame.unionAll, found).join(names, "name").select("doc_id", "item_id", "start_word", "n_words", "similarity")


def _scan(docs: DataFrame, id_col: str, text_col: str, sent, shingle: int, similarity: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(sent.value, shingle)
        for pdf in batches:
            out = [(d, *x) for d, t in zip(pdf["id"], pdf["t"]) for x in index.search(t, similarity)]
            yield pd.DataFrame(out, columns=["doc_id", "name", "start_word", "n_words", "similarity"])

    # ids go as text: pandas would make floating point numbers of them beside a null
    part = docs.select(docs[f"`{id_col}`"].cast("string").alias("id"), docs[f"`{text_col}`"].alias("t"))
    out = part.mapInPandas(run, "doc_id string, name string, start_word long, n_words long, similarity double")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.select(f"`{id_col}`").schema[0].dataType))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that hold no benchmark item (see contaminated()), columns as they are.  Rows with null id stay."""
    bad = contaminated(docs, benchmark, id_col, **how).select(F.col("doc_id").alias("__bad")).where("__bad is not null").distinct()
    return docs.join(bad, docs[f"`{id_col}`"] == bad["__bad"], "left_anti")
