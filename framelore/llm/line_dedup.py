"""Line deduplication by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelore.llm.common import SPACE, save

#: More than this share of a host's pages, and at least so many of them.
RATIO, LEAST = 0.1, 2
#: So many boilerplate lines are sent to the tasks at most: about 20 MB.
FEW_LINES = 200_000


def boilerplate_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """Rows (host, key, pages, host_pages): lines, by a 128-bit key, on more than ``ratio`` of the rows of their host.

    A line counts once for each row that holds it; lines are compared trimmed, with white space as single spaces; blank
    lines don't count.  A line on fewer than ``least`` pages is not repeated, and so never boilerplate.  A null host is a
    host of its own; null text has no lines, but its row counts as a page.  An empty table gives an empty result.
    """
    host, text = docs[f"`{host_col}`"], docs[f"`{text_col}`"]
    lines = docs.select(host.alias("host"), F.explode(F.array_distinct(_keys(text))).alias("key"))
    pages = lines.groupBy("host", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    totals = docs.groupBy(host.alias("h")).agg(F.count("*").alias("host_pages"))
    return pages.join(totals, F.col("host").eqNullSafe(F.col("h"))).drop("h").where(F.col("pages") > ratio * F.col("host_pages"))


def _keys(text: Column) -> Column:
    """Keys of the lines of a text that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _key), lambda k: k.isNotNull())


def _key(line: Column) -> Column:
    """MD5 of a line in plain form; null for a blank one.  Few lines need the regular expression, which is the slow part."""
    odd = reduce(Column.__or__, (F.contains(line, F.lit(x)) for x in ("  ", "\t", "\r", "\x0b", "\x0c")))
    plain = F.trim(F.when(odd, F.regexp_replace(line, SPACE, " ")).otherwise(line))
    return F.when(plain != "", F.md5(plain.cast("binary")))


def drop_boilerplate_lines(
    docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least: int = LEAST
) -> DataFrame:
    """Every row of docs, its boilerplate lines gone from text_col, and the columns n_lines and n_dropped.

    See boilerplate_lines() for what is dropped.  Other lines stay as they are, in their order, blank ones too; null
    text stays null, with no lines.  Columns called n_lines or n_dropped give way, others keep values and names.
    Repeated rows stay repeated; very long texts are cut as any other; an empty table gives an empty result.  The table of
    boilerplate lines is small beside the lines (at most 1 / ratio times the lines of an average page for each host).  It
    is counted: up to FEW_LINES it is sent to the tasks, and no text moves; beyond, lines meet it by host and key, and
    texts move once, by id.
    """
    bad = save(boilerplate_lines(docs, host_col, text_col, ratio, least).select("host", "key"), "lines")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    row = F.struct(*(docs[f"`{c}`"].alias(c) for c in names))
    packed = docs.select(row.alias("row"), docs[f"`{id_col}`"].alias("i"), docs[f"`{host_col}`"].alias("h"), docs[f"`{text_col}`"].alias("t"))
    if bad.count() <= FEW_LINES:
        mine = F.broadcast(bad.groupBy("host").agg(F.collect_set("key").alias("bad")))
        found = packed.join(mine, F.col("h").eqNullSafe(F.col("host")), "left")
    else:
        lines = packed.select("i", "h", F.explode(F.array_distinct(_keys(F.col("t")))).alias("k"))
        mine = lines.join(bad, F.col("h").eqNullSafe(F.col("host")) & (F.col("k") == F.col("key")), "left_semi")
        mine = mine.groupBy(F.col("i").alias("j"), F.col("h").alias("host")).agg(F.collect_set("k").alias("bad"))
        found = packed.join(mine, F.col("i").eqNullSafe(F.col("j")) & F.col("h").eqNullSafe(F.col("host")), "left")
    lines = F.transform(F.split("t", "\n"), lambda x: F.struct(x.alias("line"), _key(x).alias("key")))
    cut = found.select("row", "t", F.when(F.col("bad").isNotNull(), lines).alias("lines"), "bad")
    held = cut.select("row", "t", "lines", F.array_intersect(F.transform("lines", lambda x: x["key"]), "bad").alias("held"))
    kept = F.filter("lines", lambda x: x["key"].isNull() | ~F.array_contains("held", x["key"]))
    kept = held.select("row", "t", F.when(F.size("held") > 0, kept).alias("kept"), F.when(F.col("t").isNull(), 0).otherwise(F.size(F.split("t", "\n"))).cast("long").alias("n_lines"))
    text = F.when(F.col("kept").isNull(), F.col("t")).otherwise(F.array_join(F.transform("kept", lambda x: x["line"]), "\n"))
    left = F.when(F.col("kept").isNull(), F.col("n_lines")).otherwise(F.size("kept").cast("long"))
    return kept.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names), "n_lines", (F.col("n_lines") - left).alias("n_dropped"))
