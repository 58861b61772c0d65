"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a fingerprint between them, at most ``radius / 2`` bits from each.
So every fingerprint emits all variants within half the radius, and two that link meet at a variant.  The shuffle is on
a prefix of the variant (its lowest bits): a fingerprint goes once to each prefix that its ball touches, and the task
that owns the prefix expands the variants lying there, slice by slice, so that neither the shuffle nor a task ever holds
all of them.  The prefix grows with the number of fingerprints, so that a task holds a bounded number of them; equal
fingerprints go as one.  Colliding pairs are deduplicated and verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import acos, ceil, comb, log, pi

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelore.llm.common import Scratch, connected_components, free, save, sent_if_small

SEED = 42
#: Shingles per step of the bit counts, and variants that a task expands at once: they bound memory, not results.
STEP, VARIANTS = 255 * 512, 1 << 21


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], n: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each n-word shingle, repeats included; fewer words: of the whole sequence; none: empty."""
    if not words:
        return np.zeros(0, np.uint64)
    line, k = b" ".join(words), max(1, len(words) - n + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    last = ends[n - 1 :] if len(words) >= n else ends[-1:]
    return np.fromiter((digest(line[i:j], seed) for i, j in zip(starts[:k].tolist(), last.tolist())), np.uint64, k)


#: Odd multipliers of the words of a shingle.
WORD = np.random.default_rng(7).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """XXH64 of words, remembered; forgets all where they get too many, which bounds memory and changes no result."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(29))


def shingle_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for each n-word shingle of hashed words; for fewer words there is none."""
    k = max(0, len(codes) - n + 1)
    with np.errstate(over="ignore"):
        return mixed(sum((codes[i : i + k] * WORD[i] for i in range(n)), np.zeros(k, np.uint64)))


def shingle_set(codes: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct keys of a text's n-word shingles; fewer words: of the whole sequence; none: empty."""
    return np.unique(shingle_keys(codes, min(n, len(codes)))) if len(codes) else np.zeros(0, np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, lowest first."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), STEP):
        bits = np.unpackbits(h[i : i + STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        pad = -len(bits) % 255
        bits = np.concatenate((bits, np.zeros((pad, 64), np.uint8))) if pad else bits
        # up to 255 rows of bytes are summed as eight 64-bit lanes: no byte can overflow
        total += bits.view(np.uint64).reshape(-1, 255, 8).sum(1).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return total


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if more than half the hashes have it; no hashes: zero."""
    return int(np.packbits(2 * bit_counts(h) > len(h), bitorder="little").view("<u8")[0])


def simhash_column(shingle: int):
    """A pandas UDF from text to fingerprint, as a signed long."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        out = [fingerprint(shingle_hashes(words_of(t), shingle)) for t in texts]
        return pd.Series(np.array(out, np.uint64).view(np.int64))

    return simhash


#: The lowest bits of a parity sketch hold the size of its set; a size that does not fit them rules nothing out.
SIZE_BITS = 24
MOST = (1 << SIZE_BITS) - 1


def parity_sketch(unique: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits as words: a set's size, then for each of the other bits whether an odd number of hashes falls on it.

    Two sets differ in at least as many elements as their odd bits differ (odd sketch, Mitzenmacher et al. 2014).
    """
    at = (unique % np.uint64(width - SIZE_BITS)).astype(np.int64)
    odd = np.r_[np.zeros(SIZE_BITS, bool), (np.bincount(at, minlength=width - SIZE_BITS) & 1).astype(bool)]
    out = np.packbits(odd, bitorder="little").view("<u8").copy()
    out[0] |= np.uint64(min(len(unique), MOST))
    return out


def may_be_similar(a: Column, b: Column, width: int, similarity: float) -> Column:
    """Whether two parity sketches (arrays of longs) can have a Jaccard similarity so high; false proves that the sets have less.

    Sets of similarity s differ in (|A| + |B|) (1 - s) / (1 + s) elements.
    """
    size = lambda x: F.get(x, F.lit(0)).bitwiseAND(F.lit(MOST))
    differ = [F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))) for i in range(width // 64)]
    differ[0] = F.shiftrightunsigned(differ[0], SIZE_BITS)
    least = sum((F.bit_count(x) for x in differ[1:]), F.bit_count(differ[0]))
    maybe = least * (1 + similarity) <= (size(a) + size(b)) * (1 - similarity) + 1e-6
    return maybe | (F.greatest(size(a), size(b)) == MOST)


def many_bit_counts(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """bit_counts() of h hashed with each of the keys again: one row for each."""
    total = np.zeros((len(keys), 64), np.int64)
    for i in range(0, len(h), 255 * 8):
        part = _mix(h[i : i + 255 * 8], keys[:, None])
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(keys), -1, 8), axis=2, bitorder="little").view(np.uint64)
        for j in range(0, part.shape[1], 255):  # no byte of a lane can overflow
            total += bits[:, j : j + 255].sum(1).view(np.uint8).reshape(-1, 64)
    return total


def sketch_column(shingle: int, tables: int, bits: int, parity: int):
    """A pandas UDF from text to (digest of its words, ``tables`` independent fingerprints of ``bits`` bits, parity sketch).

    Fingerprints and sketch are of the set of shingles, which similarity is measured on: repeats count once.
    """
    need = -(-tables * bits // 64)
    keys = np.array([int.from_bytes(hashlib.sha256(b"table %d" % t).digest()[:8], "little") | 1 for t in range(need)], np.uint64)

    @F.pandas_udf("digest binary, fps array<long>, odd array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        digests, fps, odd, hashes = [], [], [], WordHashes()
        for t in texts:
            words = words_of(t)
            h = shingle_set(hashes.of(words), shingle)
            flat = (2 * many_bit_counts(h, keys) > len(h)).ravel()[: tables * bits].reshape(tables, bits)
            wide = np.zeros((tables, 64), bool)
            wide[:, :bits] = flat
            fps.append(np.packbits(wide, axis=1, bitorder="little").view("<i8").ravel().tolist())
            odd.append(parity_sketch(h, parity).view(np.int64).tolist())
            digests.append(_digest(words))
        return pd.DataFrame({"digest": digests, "fps": fps, "odd": odd})

    return sketch


def _mix(h: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Another hash of the same shingles (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        z = h * key + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@lru_cache(None)
def masks(bits: int, most: int) -> np.ndarray:
    """All 64-bit words with at most ``most`` of the lowest ``bits`` bits set."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.uint64)


def _ball(bits: int, most: int) -> int:
    return sum(comb(bits, k) for k in range(most + 1))


def collisions(ids: np.ndarray, fps: np.ndarray, left: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of records that meet at a variant: (rows, group number) sorted by group and id, slice by slice.

    left: how many of the lowest ``bits`` bits each record may still flip.  Too many variants are halved by a bit.
    """
    if len(ids) < 2:
        return
    if bits and sum(int((left == k).sum()) * _ball(bits, k) for k in range(int(left.max()) + 1)) > VARIANTS:
        one = (fps & np.uint64(1)).astype(bool)
        for side in (False, True):
            rest = left - (one != side)
            stay = np.flatnonzero(rest >= 0)
            for rows, group in collisions(ids[stay], fps[stay] >> np.uint64(1), rest[stay], bits - 1):
                yield stay[rows], group
        return
    zs, recs = [], []
    for k in range(int(left.max()) + 1):
        own = np.flatnonzero(left == k)
        m = masks(bits, k)
        for i in range(0, len(own), max(1, VARIANTS // len(m))):
            part = own[i : i + max(1, VARIANTS // len(m))]
            zs.append((fps[part, None] ^ m).ravel())
            recs.append(np.repeat(part.astype(np.int32), len(m)))
    z, rec = np.concatenate(zs), np.concatenate(recs)
    ordered = np.sort(z)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return
    spread = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
    with np.errstate(over="ignore"):
        seen = np.zeros(1 << 20, bool)
        seen[spread(twice)] = True
        maybe = np.flatnonzero(seen[spread(z)])
    at = np.searchsorted(twice, z[maybe])
    hit = twice[np.minimum(at, len(twice) - 1)] == z[maybe]
    group, rows = at[hit], rec[maybe[hit]]
    order = np.lexsort((ids[rows], group))
    yield rows[order], group[order]


#: A task gets about so many fingerprints at most, and there are at least so many tasks.
MOST_RECORDS, LEAST_TASKS = 4 << 20, 256


def plan_prefix(count: int, bits: int, tables: int, radius: int) -> int:
    """Bits of the variant to deal ``count`` fingerprints of each table by: a task holds count * ball / 2^prefix of them."""
    prefix = 1
    while prefix < bits and (tables << prefix < LEAST_TASKS or count * _ball(prefix, radius // 2) > MOST_RECORDS << prefix):
        prefix += 1
    return prefix


def plan_tables(count: int, radius: int, similarity: float, recall: float = 0.99) -> tuple[int, int]:
    """(bits, tables) for ``count`` texts: few chance meetings at a variant, and pairs of this similarity found so often.

    A bit of two sets' SimHashes differs with probability acos(c) / pi, c the cosine of the sets.
    """
    bits = 40
    while bits < 60 and count * _ball(bits, radius // 2) > 0.1 * 2**bits:
        bits += 4
    flip = acos(2 * similarity / (1 + similarity)) / pi
    hit = sum(comb(bits, k) * flip**k * (1 - flip) ** (bits - k) for k in range(radius + 1))
    return bits, ceil(log(1 - recall) / log(1 - hit))


#: The highest bit of a record's fingerprint says that several records have it: the record stands for all of them.
SEVERAL = np.uint64(1 << 63)


def _planes(rec: np.ndarray) -> bytes:
    """Records byte by byte: all their first bytes, then all their second ones; equal high bytes so shrink in the shuffle."""
    return np.ascontiguousarray(rec.view(np.uint8).reshape(-1, 16).T).tobytes()


def _records(planes: bytes) -> np.ndarray:
    """The records (id, fingerprint) that _planes() packed."""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(16, -1).T).view(np.uint64)


def _scatter(half: int, prefix: int):
    """Fingerprints to the prefixes that their balls touch: one row with packed records for each batch, table and prefix."""
    low, m = np.uint64((1 << prefix) - 1), masks(prefix, half)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, own in pdf.groupby("tbl"):
                fp = own["fp"].to_numpy(np.int64).view(np.uint64)
                to = ((fp & low)[:, None] ^ m).ravel().astype(np.int64)
                order = np.argsort(to, kind="stable")
                fp = np.where(own["several"].to_numpy(bool), fp | SEVERAL, fp) if "several" in own else fp
                rec = np.column_stack([own["id"].to_numpy(np.int64).view(np.uint64), fp])[np.repeat(np.arange(len(fp)), len(m))[order]]
                keys, first = np.unique(to[order], return_index=True)
                yield pd.DataFrame({"tbl": int(t), "prefix": keys, "records": [_planes(x) for x in np.split(rec, first[1:])]})

    return run


def _labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest of 0..n-1 that each of them is connected with by edges (a, b) and by the labels so far."""
    label = np.arange(n) if label is None else label
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], least)
        np.minimum.at(after, label[b], least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _middle(x: np.ndarray, y: np.ndarray, half: int) -> np.ndarray:
    """One fingerprint half way from x to y, always the same: the lowest half of the bits that differ is y's."""
    differ, middle = x ^ y, x.copy()
    rest, count = differ, np.bitwise_count(differ)
    for k in range(half):
        lowest = rest & (~rest + np.uint64(1))
        middle ^= np.where(count > 2 * k, lowest, np.uint64(0))
        rest = rest ^ lowest
    return middle


#: A variant where so many records meet is dense: it says that they belong together, not which pairs to look at.
DENSE = 4


def _meet(bits: int, radius: int, prefix: int, listed: bool):
    half, low, signed = radius // 2, np.uint64((1 << prefix) - 1), ~SEVERAL if listed else ~np.uint64(0)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rec = np.concatenate([_records(x) for x in pdf["records"]])
        rec = rec[np.argsort(rec[:, 0].view(np.int64), kind="stable")]
        ids, fps, n = np.ascontiguousarray(rec[:, 0]).view(np.int64), rec[:, 1] & signed, np.int64(len(rec))
        several = rec[:, 1] != fps
        left = half - np.bitwise_count((fps & low) ^ np.uint64(key[1])).astype(np.int64)
        label, few, star, waiting = np.arange(n), [np.zeros(0, np.int64)], [], 0
        for rows, group in collisions(ids, fps >> np.uint64(prefix), left, bits - prefix):
            begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            size = np.diff(np.r_[begin, len(group)])
            dense = np.repeat((size >= DENSE) | np.logical_or.reduceat(several[rows], begin), size) if listed else np.ones(len(rows), bool)
            first = np.repeat(rows[begin], size) * n + rows
            star.append(np.unique(first[dense]))
            waiting += len(star[-1])
            if waiting > VARIANTS:
                label, star, waiting = _labels(int(n), *np.divmod(np.unique(np.concatenate(star)), n), label), [], 0
            # below four records the star and the path are all pairs
            path = (group[1:] == group[:-1]) & ~dense[1:]
            pair = np.unique(np.concatenate((first[~dense], rows[:-1][path] * n + rows[1:][path])))
            x, y = np.divmod(pair, n)
            # a pair is named where its middle lies, and only there
            keep = (x != y) & (np.bitwise_count(fps[x] ^ fps[y]) <= radius)
            keep[keep] = (_middle(fps[x[keep]], fps[y[keep]], half) & low) == np.uint64(key[1])
            few.append(pair[keep])
        if star:
            label = _labels(int(n), *np.divmod(np.unique(np.concatenate(star)), n), label)
        x, y = np.divmod(np.unique(np.concatenate(few)), n)
        apart = label[x] != label[y]
        own = np.flatnonzero(label != np.arange(n))
        return pd.DataFrame({"a": np.r_[ids[label[own]], ids[x[apart]]], "b": np.r_[ids[own], ids[y[apart]]], "dense": np.r_[np.ones(len(own), bool), np.zeros(apart.sum(), bool)]})

    return run


def ball_edges(fps: DataFrame, count: int, bits: int = 64, tables: int = 1, radius: int = 4, listed: bool = False) -> DataFrame:
    """Edges (a, b, dense), a < b, that connect all ids whose fingerprints are within ``radius`` bits in any table.

    fps: rows (tbl int, fp long, id long), a fingerprint once in a table; count: about how many a table has.  ``radius`` is
    even.  A task gives each record's edge to the smallest id that it is connected with there (dense), never the pairs.
    With ``listed``, pairs that meet where fewer than four do are edges themselves (not dense), named by one task only,
    unless a record is marked ``several``; bits are 62 at most then.
    """
    prefix = plan_prefix(count, bits, tables, radius)
    dealt = fps.select("tbl", "fp", "id", *(["several"] if listed else [])).mapInPandas(_scatter(radius // 2, prefix), "tbl int, prefix long, records binary")
    met = dealt.groupBy("tbl", "prefix").applyInPandas(_meet(bits, radius, prefix, listed), "a long, b long, dense boolean")
    return met.groupBy("a", "b").agg(F.max("dense").alias("dense"))


def candidate_edges(classes: DataFrame, count: int, bits: int, tables: int, radius: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b, dense), a < b, that cover each pair of classes (id, fps) which meets in a table.

    Such a pair is an edge itself, or its ends are connected by dense edges: where four or more meet at one variant, or
    three have one fingerprint, each only gets an edge to the smallest, so edges grow with the records.  Not all pairs
    that dense edges connect are edges: dense_links() tests them.
    """
    each = classes.select("id", F.posexplode("fps").alias("tbl", "fp"))
    same = scratch.save(each.groupBy("tbl", "fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "fingerprints")
    equal = each.join(same.where("n > 1"), ["tbl", "fp"]).where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"), (F.col("n") > 2).alias("dense"))
    near = ball_edges(same.select("tbl", "fp", F.col("least").alias("id"), (F.col("n") > 1).alias("several")), count, bits, tables, radius, True)
    return equal.unionAll(near).groupBy("a", "b").agg(F.max("dense").alias("dense"))


#: Most records and bytes of shingle sets in a block of a dense cluster, columns of a block's matrix: they bound memory, not results.
BLOCK, BLOCK_BYTES, COLUMNS = 512, 1 << 22, 4096


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a with sets b, exactly: a row for each of a, a column for each of b."""
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(count > 1) - 1
    row, at = row[count[at] > 1], column[at[count[at] > 1]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    total = np.zeros((len(a), len(b)), np.int64)
    for c in range(0, int((count > 1).sum()), COLUMNS):
        i, j = np.searchsorted(at, (c, c + COLUMNS))
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[row[i:j], at[i:j] - c] = 1
        total += (x[a] @ x[b].T).astype(np.int64)
    return total


def _test_tile(similarity: float):
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        roots, root = np.unique(pdf["root"].to_numpy(np.int64), return_inverse=True)
        if len(roots) < 2:
            return none
        sets, block = [np.frombuffer(x, np.uint64) for x in pdf["set"]], pdf["block"].to_numpy()
        a, b = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
        size = np.array([len(s) for s in sets])
        both = _shared(sets, a, b)
        linked = both / np.maximum(1, size[a][:, None] + size[b] - both) >= similarity
        i, j = np.nonzero(linked & (root[a][:, None] != root[b]))
        label = _labels(len(roots), root[a][i], root[b][j])
        own = np.flatnonzero(label != np.arange(len(roots)))
        return pd.DataFrame({"a": roots[label[own]], "b": roots[own]})

    return run


def dense_links(members: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of roots that connect all roots of a cluster which hold records of so high a Jaccard similarity.

    members: rows (cluster, id, root, set).  Every two records of a cluster with different roots are compared exactly, in
    tiles of two blocks; a tile gives a spanning forest, never its pairs.  Records of a cluster's most frequent root are
    not compared with one another.  Clusters with one root have nothing to test.
    """
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES))
    roots = members.groupBy("cluster", "root").agg(F.count("*").alias("n"), F.sum(F.octet_length("set")).alias("size"))
    most = F.max(F.struct("n", "size", "root"))
    open_ = roots.groupBy("cluster").agg(most.alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("roots")).where("roots > 1")
    open_ = open_.select(
        "cluster", F.col("most.root").alias("major"), blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("minor_blocks"),
        blocks(F.col("most.n"), F.col("most.size")).alias("major_blocks"),
    )
    rows = members.join(open_, "cluster").withColumn("is_major", F.col("root") == F.col("major"))
    block = F.expr("if(is_major, minor_blocks + pmod(xxhash64(id), major_blocks), pmod(xxhash64(id), minor_blocks))")
    with_ = F.expr("sequence(0L, if(is_major, minor_blocks, minor_blocks + major_blocks) - 1)")
    tiles = rows.withColumn("block", block).select("cluster", "root", "set", "block", F.explode(with_).alias("with")).select(
        "cluster", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "root", "set", "block"
    )
    return tiles.groupBy("cluster", "p", "q").applyInPandas(_test_tile(similarity), "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits) and component_id, the smallest id reachable by links.

    Fingerprints link at ``radius`` or fewer differing bits.  Null text counts as empty (fingerprint zero, linked like
    any other); repeated rows and equal texts share a fingerprint; rows with null id get their component's smallest
    id, null only if it has none.  Very long texts are read whole.  Only id_col and text_col are read, so other columns
    may have any names.  An empty table gives an empty result.
    """
    base = docs.select(docs[f"`{id_col}`"].alias("id"), simhash_column(shingle)(docs[f"`{text_col}`"]).alias("fp"))
    base = save(base, "simhash")
    with Scratch() as scratch:
        classes = scratch.save(base.groupBy("fp").agg(F.min("id").alias("least")), "classes")
        edges = ball_edges(classes.select(F.lit(0).alias("tbl"), "fp", F.col("fp").alias("id")), classes.count(), 64, 1, radius)
        roots = connected_components(edges.select("a", "b"), scratch)
        named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        least = named.groupBy("root").agg(F.min("least").alias("component_id"))
        of = save(named.join(least, "root").select("fp", "component_id"), "components")
    return base.join(of, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _sets(shingle: int):
    """A pandas UDF from text to (digest of its words, sorted hashes of its set of shingles)."""

    @F.pandas_udf("digest binary, set binary")
    def sets(texts: pd.Series) -> pd.DataFrame:
        words, hashes = [words_of(t) for t in texts], WordHashes()
        return pd.DataFrame({"digest": [_digest(w) for w in words], "set": [shingle_set(hashes.of(w), shingle).tobytes() for w in words]})

    return sets.asNondeterministic()  # else a filter on the digest would be pushed down, and all texts hashed


def _jaccard():
    """A pandas UDF from two sets of hashes to their Jaccard similarity."""

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: bytes, y: bytes) -> float:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both / max(1, len(x) + len(y) - both)

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return jaccard


def _groups(
    docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, shingle: int = 5, similarity: float = 0.8, radius: int = 4, bits: int | None = None,
    tables: int | None = None, parity: int = 384,
) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): (id, digest) of each row of docs that has an id, and (digest, least, root) of each distinct text.

    least: the smallest id with the text; root: a number that all texts of a group share.
    """
    text = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    if not (bits and tables):
        bits, tables = plan_tables(docs.count(), radius, similarity)
    base = text.select("id", sketch_column(shingle, tables, bits, parity)("text").alias("s"))
    base = scratch.save(base.select("id", "s.digest", "s.fps", "s.odd"), "sketch")
    classes = base.groupBy("digest").agg(F.min("id").alias("least"), F.any_value("fps").alias("fps"), F.any_value("odd").alias("odd"))
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("id"), "*"), "classes")
    edges = scratch.save(candidate_edges(classes, classes.count(), bits, tables, radius, scratch), "pairs")
    free(docs.sparkSession)
    names = classes.select("id", "digest", "least")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Shingle sets of the classes wanted (id), from the rows that have the class's smallest id."""
        own = scratch.save(names.join(wanted, "id", "left_semi").select("id", "digest", F.col("least").alias("__least")), "wanted")
        ids, digests = sent_if_small(own.select("__least")), sent_if_small(own.select("id", "digest"))
        rows = text.join(ids, F.col("id") == F.col("__least"), "left_semi").select(_sets(shingle)("text").alias("s"))
        return scratch.save(rows.select("s.digest", "s.set").join(digests, "digest").dropDuplicates(["id"]).select("id", "set"), "sets")

    odd = lambda end: classes.select(F.col("id").alias(end), F.col("odd").alias(f"odd_{end}"))
    maybe = edges.select("a", "b").join(odd("a"), "a").join(odd("b"), "b").where(may_be_similar(F.col("odd_a"), F.col("odd_b"), parity, similarity))
    maybe = scratch.save(maybe.select("a", "b"), "maybe")
    sets = sets_of(maybe.select(F.col("a").alias("id")).union(maybe.select("b")).distinct())
    links = maybe.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").where(_jaccard()("x", "y") >= similarity).select("a", "b")
    roots = scratch.save(connected_components(links, scratch).toDF("id", "root"), "roots")
    free(docs.sparkSession)
    # clusters of dense meetings that verified pairs have not made one group: the rest of their pairs is tested in tiles
    clusters = connected_components(edges.where("dense").select("a", "b"), scratch).toDF("id", "cluster")
    members = scratch.save(clusters.join(roots, "id", "left").select("cluster", "id", F.coalesce("root", "id").alias("root")), "members")
    open_ = members.groupBy("cluster").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("cluster")
    members = members.join(open_, "cluster", "left_semi")
    more = scratch.save(dense_links(members.join(sets_of(members.select("id")), "id"), similarity), "more")
    merged = scratch.save(connected_components(more, scratch).toDF("root", "top"), "merged")
    of = classes.select("id", "digest", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    return base.select("id", "digest"), of.join(merged, "root", "left").select("digest", "least", F.coalesce("top", "root").alias("root"))


def near_duplicate_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows (id_col, digest, component_id, copies), one for each distinct id and text of docs: the smallest id of its group, its rows.

    One 64-bit fingerprint of radius 4 misses most pairs at a Jaccard ``similarity`` of 0.8, so ``tables`` independent
    fingerprints of ``bits`` bits are hashed the same way (by default as many as find a pair at that similarity 99 times
    in 100, see plan_tables()); a pair that meets in any of them is verified exactly on the sets of its ``shingle``-word
    shingles, unless its parity sketches (``parity`` bits, a multiple of 64) already prove it less similar.  Texts of
    equal words are one class and are never paired.  Null text is empty; empty texts are copies of each other; texts of
    fewer words than a shingle are one shingle; very long texts are read whole.  Ids may be of any type that orders, and
    may have several texts.  Rows with null id are left out.  An empty table gives an empty result.
    """
    with Scratch() as scratch:
        rows, classes = _groups(docs, id_col, text_col, scratch, **how)
        least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
        named = classes.join(least, "root").select("digest", "component_id")
        out = rows.groupBy("id", "digest").agg(F.count("*").alias("copies")).join(named, "digest")
        return save(out.select(F.col("id").alias(id_col), "digest", "component_id", "copies"), "near")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs without near copies: of each group (see near_duplicate_ids()) the row with the smallest id stays, once.

    Columns stay as they are, whatever their names.  Where rows of different texts share an id, each text is a document
    of its own; of a group in which several have the smallest id, the one with the smallest digest stays.  Repeated rows
    stay once.  Rows with null id cannot be named and stay.  An empty table gives an empty result.
    """
    shingle = how.get("shingle", 5)
    with Scratch() as scratch:
        rows, classes = _groups(docs, id_col, text_col, scratch, **how)
        keep = classes.groupBy("root").agg(F.min(F.struct("least", "digest")).alias("k")).select(F.col("k.least").alias("k"), F.col("k.digest").alias("digest"))
        keep = scratch.save(keep, "keep")
        counts = rows.groupBy(F.col("id").alias("k")).agg(F.count("*").alias("n"))
        several = save(keep.join(counts.where("n > 1"), "k").select("k", "digest"), "several")
        # ids that leave some row out: far fewer, as a rule, than those that stay
        touched = counts.join(keep.select("k", F.lit(True).alias("kept")).distinct(), "k", "left").where("kept is null or n > 1")
        touched = save(touched.select("k"), "touched")
    packed = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    rest = packed.join(sent_if_small(touched), F.col("i") == F.col("k"), "left_anti")
    several = sent_if_small(several)
    again = packed.join(several.select("k"), F.col("i") == F.col("k"), "left_semi").select("row", "i", _sets(shingle)("t")["digest"].alias("d"))
    again = again.join(several, (F.col("i") == F.col("k")) & (F.col("d") == F.col("digest"))).dropDuplicates(["i", "d"])
    return rest.select("row").unionAll(again.select("row")).select("row.*")
