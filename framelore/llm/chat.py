"""Chat formatting of typed content parts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Placeholder and tokens that it stands for where a part doesn't say.
KINDS = {"image": ("<|image|>", 576), "audio": ("<|audio|>", 750), "document": ("<|document|>", 1024)}
#: Turns of a conversation that are gathered together before whole conversations are.
CHUNK = 256
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    r"""No control string is left: "\" becomes "\\", then "<|" becomes "<\|".  unescape() is its inverse on all texts."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as content parts."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def visit(parts: Column) -> Column:
    """Each part flattened: what stands in the text, the attachment it refers to (null for text) and its tokens."""

    def one(p: Column) -> Column:
        kind = F.coalesce(p["type"], F.lit("text"))
        shown = escape(F.coalesce(p["text"], F.lit("")))
        count = F.lit(0).cast("long")
        for name, (mark, tokens) in KINDS.items():
            shown = F.when(kind == name, F.lit(mark)).otherwise(shown)
            count = F.when(kind == name, F.coalesce(p["tokens"], F.lit(tokens).cast("long"))).otherwise(count)
        ref = F.when(kind.isin(*KINDS), F.struct(kind.alias("type"), p["ref"].alias("ref"), count.alias("tokens")))
        return F.struct(shown.alias("shown"), ref.alias("ref"), count.alias("tokens"))

    return F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), one)


def format_chat(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None,
    text_col: str = "text", learn: str = "assistant",
) -> DataFrame:
    """One row per conversation: conv_col, formatted, mask, attachments, expanded_tokens.

    A turn is <|im_start|>role<|im_sep|>content<|im_end|> and a line feed; role and texts are escaped.  mask: array of
    (start, length) in code points of formatted, the contents of the turns of role ``learn`` (placeholders included),
    in order.  attachments: array of (type, ref, tokens) in the order of their placeholders.  Turns go by turn_col
    (null first), ties by role, then content; null role and text are empty; parts of unknown type are text.  Rows with null
    conv_col form one conversation.  No rows, no conversations.  Turns are gathered in chunks, then chunks.
    """
    seen = visit(parts if parts is not None else text_parts(F.col(text_col)))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), seen.alias("seen"))
    content = F.array_join(F.transform("seen", lambda x: x["shown"]), "")
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    rows = rows.select(
        "conv", F.floor(F.col("turn") / CHUNK).alias("chunk"), "turn", "role", content.alias("content"), F.char_length(head).alias("skip"),
        F.concat(head, content, F.lit(END + "\n")).alias("shown"),
        F.filter(F.transform("seen", lambda x: x["ref"]), lambda r: r.isNotNull()).alias("refs"),
        F.aggregate(F.transform("seen", lambda x: x["tokens"]), F.lit(0).cast("long"), lambda a, b: a + b).alias("tokens"),
    )
    inside = W.partitionBy("conv", "chunk").orderBy("turn", "role", "content")
    rows = rows.withColumn("nth", F.row_number().over(inside))
    rows = rows.withColumn("at", F.sum(F.char_length("shown").cast("long")).over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.char_length("shown"))
    span = F.struct((F.col("at") + F.col("skip")).alias("start"), F.char_length("content").cast("long").alias("length"))
    in_order = F.sort_array(F.collect_list(F.struct("nth", "shown", F.when(F.col("role") == learn, span).alias("span"), "refs")))
    chunks = rows.groupBy("conv", "chunk").agg(in_order.alias("t"), F.sum("tokens").alias("tokens"))
    chunks = chunks.select(
        "conv", "chunk", "tokens", F.array_join(F.transform("t", lambda x: x["shown"]), "").alias("shown"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull()).alias("spans"), F.flatten(F.transform("t", lambda x: x["refs"])).alias("refs"),
    )
    of_conv = W.partitionBy("conv").orderBy(F.col("chunk").asc_nulls_first())
    chunks = chunks.withColumn("before", F.sum(F.char_length("shown").cast("long")).over(of_conv.rowsBetween(W.unboundedPreceding, 0)) - F.char_length("shown"))
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("before")).alias("start"), s["length"].alias("length")))
    chunks = chunks.select("conv", "before", "chunk", "tokens", "shown", moved.alias("spans"), "refs")
    whole = chunks.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("before", "chunk", "shown", "spans", "refs"))).alias("c"), F.sum("tokens").alias("expanded_tokens")
    )
    return whole.select(
        F.col("conv").alias(conv_col), F.array_join(F.transform("c", lambda x: x["shown"]), "").alias("formatted"),
        F.flatten(F.transform("c", lambda x: x["spans"])).alias("mask"), F.flatten(F.transform("c", lambda x: x["refs"])).alias("attachments"), "expanded_tokens",
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        two = F.split(piece, r"<\|im_sep\|>")
        text = F.element_at(F.split(F.element_at(two, 2), r"<\|im_end\|>"), 1)
        return F.struct(unescape(F.element_at(two, 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, in order, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")
