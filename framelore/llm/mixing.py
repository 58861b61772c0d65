"""Mixing sources to target weights with fixed-length blocks, in DataFrame functions only.

The words of a source, its documents in a fixed pseudorandom order, are cut into blocks of ``block`` words.  A source
gets as many slots of the mix as its target holds blocks, the last one cut to the words that are left.  Each output shard
has a fixed number of slots, and each slot draws its source with the sources' shares of all slots, so the counts of the
sources in a shard are multinomial.  What the draws of all shards give a source beyond its slots goes to sources that
got too few, so that totals meet the targets.  Slot i of a source is mapped through a pseudorandom permutation of the
source's block indices, another one each time round, and blocks are joined by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelore.llm.common import SPACE, Scratch, save, word_count

BLOCK, SHARD, CAP, SEED = 128, 4096, 3, 17
WEIGHTS = (1, 2, 3)
#: Rounds of a permutation; cells that sources' ranges of slots are found by; so many sources are sent to the tasks at most.
ROUNDS, CELLS, FEW = 8, 1 << 16, 10_000


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """df with the sum of each column over the rows before, in this order, by partitions of one sort: no task sees all rows."""
    rows = df.orderBy(*order).withColumns({f"__{k}": v.cast("long") for k, v in sums.items()} | {"__at": F.monotonically_increasing_id()})
    rows = scratch.save(rows.withColumn("__part", F.shiftright("__at", 33)), "running")
    before = lambda w, k: F.coalesce(F.sum(f"__{k}").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("__part").agg(*(F.sum(f"__{k}").alias(f"__{k}") for k in sums))
    by_part, within = W.partitionBy(F.lit(0)).orderBy("__part"), W.partitionBy("__part").orderBy("__at")
    ahead = parts.select("__part", *(before(by_part, k).alias(f"__{k}_ahead") for k in sums))
    out = rows.withColumns({k: before(within, k) for k in sums}).join(F.broadcast(ahead), "__part")
    return out.withColumns({k: F.col(k) + F.col(f"__{k}_ahead") for k in sums}).drop("__part", "__at", *(f"__{k}" for k in sums), *(f"__{k}_ahead" for k in sums))


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size): shares of all sizes by weight, capped.

    Sources by code point, null last, take the weights in turn.  A target stops at cap times the source's size; what is
    above goes to the others by weight until none is above.  That fixed point is found directly: by size over weight,
    a source is capped if the shares at its own level, with all before it capped, don't exceed the whole.
    """
    last = F.col("source").asc_nulls_last()
    ranked = running(sizes.select("source", "source_size"), [last], {"rank": F.lit(1)}, scratch)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = scratch.save(ranked.select("source", "source_size", w.cast("long").alias("w"), (F.lit(cap) * F.col("source_size")).alias("cap")), "ranked")
    total, all_w = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    out = running(ranked, [F.col("cap") / F.col("w"), last], {"cap_before": F.col("cap"), "w_before": F.col("w")}, scratch)
    wide = lambda c: c.cast("decimal(38,0)")
    own = wide(F.col("cap_before")) * F.col("w") + wide(F.col("cap")) * (F.lit(all_w) - F.col("w_before"))
    out = scratch.save(out.withColumn("capped", own <= wide(F.lit(total)) * F.col("w")), "capped")
    spent, free = out.agg(F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)), F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w")))).first()
    share = F.lit((total or 0) - (spent or 0)).cast("double") * F.col("w") / F.lit(free or None).cast("long")
    return out.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _random(columns: list[Column | str], n: Column) -> Column:
    """A number below n from the MD5 of texts, the same in other engines."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns).cast("binary")), 1, 13), 16, 10).cast("long") % n


def plan_documents(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int, scratch: Scratch) -> DataFrame:
    """Rows (id, source, size, start, bucket, rn): each document's place, in words, in its source.

    Places are prefix sums in two steps: over 4,096 buckets of a source, then in a bucket, so a hot source is no single task.
    """
    base = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{source_col}`"].alias("source"), word_count(docs[f"`{text_col}`"]).alias("size"))
    bucket = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")), 1, 3)
    base = scratch.save(base.withColumn("bucket", bucket), "mix")
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    within = W.partitionBy("source", "bucket").orderBy("id", "size")
    sized = base.select("*", (F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("inside"), F.row_number().over(within).alias("rn"))
    same = sized["source"].eqNullSafe(sums["source"]) & (sized["bucket"] == sums["bucket"])
    placed = sized.join(sums, same).select("id", sized["source"], "size", (F.col("ahead") + F.col("inside")).alias("start"), sized["bucket"], "rn")
    return save(placed, "mix")


def plan_sources(documents: DataFrame, weights: tuple[int, ...], cap: int, block: int, seed: int, scratch: Scratch) -> DataFrame:
    """Rows (source, source_size, target, blocks, rest, slots, key, turns): what each source gives to the mix.

    rest: words of the last, unfinished round through its blocks; key, turns: what its permutations are made of.
    """
    sizes = documents.groupBy("source").agg(F.sum("size").alias("source_size"))
    s, size = targets(sizes, scratch, weights, cap), F.col("source_size")
    words = F.coalesce(F.round("target").cast("long"), F.lit(0).cast("long"))
    s = s.withColumns({"blocks": F.ceil(size / block), "words": F.when(size > 0, words).otherwise(0)})
    s = s.withColumns({"rest": F.when(size > 0, F.col("words") % size).otherwise(0), "rounds": F.when(size > 0, F.floor(F.col("words") / size)).otherwise(0)})
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).cast("binary"))
    s = s.withColumns({"slots": F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / block), "key": key})
    whole = F.greatest(F.col("blocks") - 1, F.lit(1))
    turn = lambda e: F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: _random([F.col("key"), e.cast("string"), r.cast("string")], whole))
    return s.withColumn("turns", F.transform(F.sequence(F.lit(0), F.lit(cap)), turn)).drop("words", "rounds")


def permuted() -> Column:
    """Block that slot number ``at`` of round ``e`` of a source holds: the whole blocks permuted (swap-or-not), a last, shorter one last.

    Each round pairs every index with another one and swaps a pair, or not, by a hash that both share.
    """
    # x: index, r: round; an index and its partner differ from one another by the turn of the round
    partner = "pmod(turns[e][r] - x, blocks - 1)"
    swap = f"substr(md5(cast(concat_ws(':', key, cast(e as string), cast(r as string), cast(greatest(x, {partner}) as string)) as binary)), 1, 1) >= '8'"
    return F.expr(f"if(at >= blocks - 1, at, aggregate(sequence(0, {ROUNDS - 1}), at, (x, r) -> if({swap}, {partner}, x)))")


def draw_slots(sources: DataFrame, total: int, shard: int, seed: int, scratch: Scratch) -> DataFrame:
    """Rows (shard, place, source, slot): each of ``total`` places of the shards draws a source; slot: its number in the source.

    sources: rows (source, slots, low), low being the slots of the sources before.  A draw beyond a source's slots goes
    to one that was drawn too seldom.
    """
    spark, width = sources.sparkSession, max(1, -(-total // CELLS))
    few = sources.count() <= FEW
    send = F.broadcast if few else lambda d: d
    cells = F.sequence(F.floor(F.col("low") / width), F.floor((F.col("low") + F.col("slots") - 1) / width))
    ranges = sources.where("slots > 0").select("source", "low", "slots", F.explode(cells).alias("cell"))
    drawn = spark.range(total).select(F.col("id").alias("place"), F.floor(F.col("id") / shard).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias("v"))
    # the slots of a source are numbered chunk by chunk, places being in chunks at random, so that no shard settles more than others
    drawn = drawn.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.lit(max(1, -(-total // shard)))))
    drawn = drawn.withColumn("cell", F.floor(F.col("v") / width)).join(send(ranges), "cell").where("v >= low and v < low + slots")
    drawn = scratch.save(drawn.select("shard", "place", "source", "slots", "chunk"), "drawn")
    counts = drawn.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("s"), F.col("chunk").alias("h"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    number = F.row_number().over(W.partitionBy("source", "chunk").orderBy("place")) - 1
    own = drawn.withColumn("number", number).join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("h")))
    own = scratch.save(own.select("shard", "place", "source", "slots", (F.col("ahead") + F.col("number")).alias("slot")), "numbered")
    # places drawn too often, and slots not drawn, meet by their ranks
    got = drawn.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("got"))
    both = sources.where("slots > 0").join(got, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "slots", F.coalesce("got", F.lit(0)).alias("got"))
    over, under = F.greatest(F.col("got") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("got"), F.lit(0))
    both = scratch.save(running(both, [F.col("source")], {"over_before": over, "under_before": under}, scratch), "settle")
    spare = own.where("slot >= slots").join(send(both.select(F.col("source").alias("s"), "over_before")), F.col("source").eqNullSafe(F.col("s")))
    spare = spare.select("shard", "place", (F.col("over_before") + F.col("slot") - F.col("slots")).alias("rank"))
    open_ = both.where("slots > got").select("source", "got", "under_before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - F.col("got") - 1)).alias("i"))
    filled = spare.join(open_.select("source", (F.col("got") + F.col("i")).alias("slot"), (F.col("under_before") + F.col("i")).alias("rank")), "rank")
    return own.where("slot < slots").select("shard", "place", "source", "slot").unionAll(filled.select("shard", "place", "source", "slot"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP, block: int = BLOCK, shard: int = SHARD, seed: int = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, pieces) of the mix.

    documents: one row (id, source, size, start, bucket, rn) per row of docs; null text has size 0.  sources: (source,
    source_size, target, blocks, rest, slots, ...).  pieces: (shard, slot, source, block, id, bucket, rn, first_word,
    n_words), the runs of words that fill each slot.  A source's words come to its target, rounded; none is taken more than
    cap times.  Null ids and sources are values like any other; repeated rows are documents of their own; very long texts
    fill many blocks; only these columns are read, so others may have any names; an empty table gives empty results.
    """
    with Scratch() as scratch:
        documents = plan_documents(docs, id_col, source_col, text_col, seed, scratch)
        sources = scratch.save(plan_sources(documents, weights, cap, block, seed, scratch), "sources")
        total = sources.agg(F.sum("slots")).first()[0] or 0
        sources = save(running(sources, [F.col("source").asc_nulls_last()], {"low": F.col("slots")}, scratch), "sources")
        slots = save(draw_slots(sources, total, shard, seed, scratch), "slots")
    s = sources.select(F.col("source").alias("__s"), "source_size", "blocks", "rest", "slots", "key", "turns")
    s = F.broadcast(s) if sources.count() <= FEW else s
    held = slots.join(s, F.col("source").eqNullSafe(F.col("__s"))).withColumns({"e": F.floor(F.col("slot") / F.col("blocks")).cast("int"), "at": F.col("slot") % F.col("blocks")})
    cut = F.when((F.col("slot") == F.col("slots") - 1) & (F.col("rest") > 0), F.col("rest") - F.col("at") * block).otherwise(F.lit(block))
    held = held.select("shard", F.col("place").alias("slot"), F.col("source").alias("__s"), permuted().alias("__b"), cut.alias("cut"))
    runs = documents.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    )
    first = F.greatest(F.col("start"), F.col("block") * block)
    runs = runs.select("source", "block", "id", "bucket", "rn", "start", "size", first.alias("first"))
    pieces = runs.join(held, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")))
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("cut"))
    pieces = pieces.where(end > F.col("first")).select(
        "shard", "slot", "source", "block", "id", "bucket", "rn", (F.col("first") - F.col("start")).alias("first_word"), (end - F.col("first")).alias("n_words")
    )
    return documents, sources, pieces


def mixed_texts(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (shard, source, slot, text): the mix itself, each slot's words joined by single spaces.

    Ids have to be unique; pieces are cut out of their texts where the texts are, and only pieces are gathered by slot.
    """
    trimmed = F.regexp_replace(F.coalesce(docs[f"`{text_col}`"], F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    texts = docs.select(docs[f"`{id_col}`"].alias("__i"), F.split(trimmed, SPACE).alias("__w"))
    cut = pieces.join(texts, F.col("id").eqNullSafe(F.col("__i")))
    cut = cut.select("shard", "source", "slot", "bucket", "rn", F.array_join(F.slice("__w", F.col("first_word").cast("int") + 1, F.col("n_words").cast("int")), " ").alias("t"))
    parts = F.sort_array(F.collect_list(F.struct("bucket", "rn", "t")))
    return cut.groupBy("shard", "source", "slot").agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))


def mix_digest(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per row of docs: id_col, source, size, source_size, target (its source's), taken (words the mix takes)."""
    documents, sources, pieces = mix(docs, id_col, **how)
    taken = pieces.groupBy("source", "bucket", "rn").agg(F.sum("n_words").alias("taken")).toDF("__s", "__b", "__r", "taken")
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")) & (F.col("rn") == F.col("__r"))
    out = documents.join(taken, same, "left").drop("__s")
    s = sources.select(F.col("source").alias("__s"), "source_size", "target")
    s = F.broadcast(s) if s.count() <= FEW else s
    out = out.join(s, F.col("source").eqNullSafe(F.col("__s")), "left")
    return out.select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
