"""Spelling variants of words, by an even-partition pigeonhole join.

Two words that differ by one edit agree in one of two halves of the shorter one: its halves are indexed, and words of equal
length or one longer probe them with their own text at the same place or one further on.  A half that too many words share
is not searched pair by pair: there the edit lies in the other half, which is halved again, until few words share what is
left.  Candidates are verified by their edit distance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelore.llm.common import Scratch, ascii_lower, drop, save, sent_if_small

RUN, LEAST_LENGTH, LEAST_COUNT, RATIO = r"[A-Za-zÀ-ÿ]+", 5, 3, 2
#: Pairs that words of one segment may make before the segment is refined.
PAIRS = 128


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
    altered: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lower-cased, of ``least_length`` code points or more, seen ``least_count`` times or more.

    altered: from the id as text (null: empty) and a lower-cased run to the word that counts.  Null and empty texts hold none;
    repeated rows count each; an empty table gives no words.  Other columns are not read.
    """
    rows = docs.select(F.coalesce(docs[f"`{id_col}`"].cast("string"), F.lit("")).alias("i"), docs[f"`{text_col}`"].alias("t"))
    # shorter runs can't become longer, so they don't leave the array
    runs = F.filter(F.regexp_extract_all(ascii_lower(F.col("t")), F.lit(RUN), 0), lambda w: F.char_length(w) >= least_length)
    word = F.explode(runs).alias("word")
    words = rows.select("i", word)
    if altered is not None:
        words = words.select(altered(F.col("i"), F.col("word")).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def mangled(every: int) -> Callable[[Column, Column], Column]:
    """Runs for which ``every`` divides h, the CRC-32 of "id:run", lose their code point h % length."""

    def altered(i: Column, run: Column) -> Column:
        h = F.crc32(F.concat(i, F.lit(":"), run).cast("binary"))
        at = (h % F.char_length(run)).cast("int")
        return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)

    return altered


def _halves(rows: DataFrame) -> DataFrame:
    """Each row (key, longer, lo, hi, word, n) twice: with the left half of its open range fixed by the key, and with the right half.

    lo and hi bound what is open in the shorter word; in a word that is longer by one it ends one place further on.
    """
    lo, hi, longer = F.col("lo"), F.col("hi"), F.col("longer")
    mid = F.floor((lo + hi) / 2).cast("int")
    left = F.struct(F.lit(0).alias("part"), F.substring("word", lo + 1, mid - lo).alias("segment"), mid.alias("lo"), hi.alias("hi"))
    right = F.struct(F.lit(1).alias("part"), F.substring("word", mid + longer + 1, hi - mid).alias("segment"), lo.alias("lo"), mid.alias("hi"))
    cut = rows.select("key", "longer", "word", "n", F.explode(F.array(left, right)).alias("s"))
    key = F.xxhash64("key", "s.part", "s.segment")  # a collision only adds candidates
    return cut.select(key.alias("key"), "longer", "s.lo", "s.hi", "word", "n")


def _pairs(rows: DataFrame) -> DataFrame:
    """(word, n, other, m) of rows that share a key and differ by one edit; groups are small, see near_words()."""
    me = F.struct("word", "n")
    groups = rows.groupBy("key").agg(
        F.collect_list(F.when(F.col("longer") == 0, me)).alias("own"), F.collect_list(F.when(F.col("longer") == 1, me)).alias("long")
    ).where((F.size("own") > 1) | ((F.size("own") > 0) & (F.size("long") > 0)))
    one = groups.select(F.explode("own").alias("a"), "own", "long")
    later = F.filter("own", lambda b: b["word"] > F.col("a")["word"])
    near = F.filter(F.concat(later, F.col("long")), lambda b: F.levenshtein(F.col("a")["word"], b["word"], 1) == 1)
    return one.select("a", F.explode(near).alias("b")).select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("m"))


def near_words(words: DataFrame, scratch: Scratch, pairs: int = PAIRS) -> DataFrame:
    """(word, n, other, m), both ways: words of (word, n) that differ by exactly one inserted, deleted or replaced code point.

    Segments whose words make at most ``pairs`` pairs are searched; the others are refined round by round.  Where one code
    point is open all words of a segment of one length are near each other, so such segments are searched whatever their number, which
    the alphabet bounds.  Words that repeat, nulls and empty words are left out beforehand.
    """
    length = F.char_length("word")
    base = words.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"), "word", "n").where(length > F.col("longer"))
    rows = base.select(F.xxhash64(length - F.col("longer")).alias("key"), "longer", F.lit(0).alias("lo"), (length - F.col("longer")).cast("int").alias("hi"), "word", "n")
    found, before = [], None
    while True:
        cut = _halves(rows)
        sizes = cut.groupBy("key").agg(F.count_if(F.col("longer") == 0).alias("own"), F.count_if(F.col("longer") == 1).alias("long"), F.max(F.col("hi") - F.col("lo")).alias("open"))
        own = F.col("own")
        hot = scratch.save(sizes.where((own * (own - 1) / 2 + own * F.col("long") > pairs) & (F.col("open") > 1)).select("key"), "hot")
        hot_keys = sent_if_small(hot)
        found.append(scratch.save(_pairs(cut.join(hot_keys, "key", "left_anti")), "links"))
        deeper = scratch.save(cut.join(hot_keys, "key", "left_semi"), "rows")
        drop(before)
        rows = before = deeper
        if deeper.isEmpty():
            break
    both = found[0]
    for more in found[1:]:
        both = both.unionAll(more)
    both = both.distinct()
    return both.unionAll(both.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))


def group_variants(words: DataFrame, ratio: float = RATIO, pairs: int = PAIRS) -> DataFrame:
    """One row per distinct word of words (word, n): word, form, root, n, n_near, form_n.

    n_near: words that differ by exactly one edit.  form: the near word of largest n (ties: smallest by code point) if its n is at
    least ``ratio`` (more than 1) times the word's own, else null.  root: where following forms ends, the word itself if it has none;
    counts grow along the way, so it ends.  Null and empty words are left out; a word that repeats has the sum of its
    counts; very long words are words; other columns are not read.  No words give no rows.
    """
    if ratio <= 1:
        raise ValueError("counts have to grow from a word to its form")
    plain = words.where(F.char_length("word") > 0).groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    with Scratch() as scratch:
        vocabulary = scratch.save(plain, "words")
        near = near_words(vocabulary, scratch, pairs)
        best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("word"))).alias("best")
        near = near.groupBy("word").agg(F.count("*").alias("n_near"), best)
        joined = vocabulary.join(near, "word", "left")
        big = F.coalesce(-F.col("best.m") >= F.col("n") * ratio, F.lit(False))
        forms = joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(big, F.col("best.word")).alias("form"), F.when(big, -F.col("best.m")).alias("form_n")
        )
        forms = scratch.save(forms, "forms")
        out = save(_with_roots(forms, scratch), "variants")
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def _with_roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """forms with root: pointers double until none changes, which takes as many rounds as the longest way has binary digits."""
    now = scratch.save(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = scratch.save(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        going = not after.where("moved").isEmpty()
        drop(now)
        now = after
        if not going:
            return forms.join(now.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
