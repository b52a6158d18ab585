"""Mixing of sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled by a hash and laid end to end; the stream is cut into blocks of equal length in words and
repeats while the target asks for more. Slots are the points of the van der Corput sequence (the bits of the slot's number
reversed) mapped through the cumulative number of blocks that the sources are to give; so every stretch of the mix holds the
sources in their shares, and each source gets exactly its blocks. The slots are ranked per source and joined with the blocks.

No step gathers a source: sums and ranks come in two levels (ranges of the hash or of the slots, then within a range), so a
source with a third of all rows is as spread as any other.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source, the last; repeated rows are
documents of their own with the same hash; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callstrata.llm.text import staged

BLOCK_WORDS = 4096
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Documents in a range of the hash, slots in a range of the schedule.
RANGE_ROWS = 4096


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, its key (never null), size in words and shuffle hash."""
    blanks = " \t\n\x0b\x0c\r"
    core = F.btrim(F.coalesce("text", F.lit("")), F.lit(blanks))
    return docs.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"),
        F.when(core == "", 0).otherwise(F.size(F.split(core, r"[\x20\x09-\x0D]+", -1))).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h"))


def targets(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: size, target in words, the words and blocks it gives, and its interval of blocks.

    The targets fill like water: sources ordered by limit over weight reach their limits first, the rest share one level.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)) + 1)
    rows = docs.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).withColumn("weight", weight)
    rows = rows.withColumn("cap", (F.col("source_size") * MOST).cast("double")).withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill, every = Window.orderBy("fill", "skey"), Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.row_number().over(by_fill)).withColumn("level", (
        F.sum("source_size").over(every) * SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("free", F.min(F.when(F.col("fill") > F.col("level"), F.struct("place", "level"))).over(every))
    target = F.when(F.col("free").isNull() | (F.col("place") < F.col("free.place")), F.col("cap")).otherwise(F.col("weight") * F.col("free.level"))
    rows = rows.withColumn("target", target).withColumn("words", F.floor(F.col("target") + 0.5)).withColumn("blocks", F.ceil(F.col("words") / block))
    upto = F.sum("blocks").over(Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("blocks")).select(
        "skey", "source_size", "n_docs", "target", "words", "blocks", "lo", "hi")


def laid_out(docs: DataFrame, goals: DataFrame, n_docs: int) -> DataFrame:
    """Documents with their place in their source's stream: range, number in it, and offset in words."""
    ranges = -(-max(n_docs, 1) // RANGE_ROWS)
    part = F.least(F.floor((F.col("h") / F.lit(float(2**64)) + 0.5) * ranges), F.lit(ranges - 1)).cast("long")
    ranged = docs.withColumn("part", part)
    sums = ranged.groupBy("skey", "part").agg(F.sum("size").alias("part_size"))
    ahead = F.sum("part_size").over(Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("part_size")
    starts = sums.withColumn("ahead", ahead).drop("part_size").join(goals.select("skey", "source_size", "target", "words"), "skey")
    own = Window.partitionBy("skey", "part").orderBy("h", "doc_id", "size")
    within = ranged.withColumn("no", F.row_number().over(own)).withColumn("upto", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return within.join(starts, ["skey", "part"]).withColumn("offset", F.col("ahead") + F.col("upto") - F.col("size")).drop("ahead", "upto", "h")


def slots(goals: DataFrame, n_blocks: int) -> DataFrame:
    """(slot, skey, block): the schedule. Exactly the blocks of every source, in van der Corput order."""
    bits = max(1, (max(n_blocks, 1) - 1).bit_length())
    point = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long")
    points = goals.sparkSession.range(2**bits).select(F.col("id").alias("slot"), point.alias("q")).filter(F.col("q") < n_blocks)
    spread = goals.filter("blocks > 0").select("skey", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / RANGE_ROWS), F.floor((F.col("hi") - 1) / RANGE_ROWS))).alias("chunk"))
    placed = points.withColumn("chunk", F.floor(F.col("q") / RANGE_ROWS)).join(spread, "chunk").filter("q >= lo AND q < hi")
    placed = placed.select("slot", "skey", F.floor(F.col("slot") / RANGE_ROWS).alias("part"))
    counts = placed.groupBy("skey", "part").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    rank = F.row_number().over(Window.partitionBy("skey", "part").orderBy("slot")) - 1
    return placed.withColumn("rank", rank).join(counts.select("skey", "part", ahead.alias("ahead")), ["skey", "part"]).select(
        "slot", "skey", (F.col("ahead") + F.col("rank")).alias("block"))


def pieces(laid: DataFrame, block: int) -> DataFrame:
    """Documents cut at block borders, once per repeat of the stream: (skey, block, part, no, first word, number of words)."""
    start = F.col("offset") + F.col("turn") * F.col("source_size")
    turns = laid.filter("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1)))).withColumn("start", start)
    turns = turns.withColumn("stop", F.least(F.col("start") + F.col("size"), F.col("words"))).filter("start < stop")
    cut = turns.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))))
    first = F.greatest("start", F.col("block") * block)
    return cut.select(
        "skey", "block", "part", "no", "doc_id", (first - F.col("start")).alias("first_word"),
        (F.least("stop", (F.col("block") + 1) * block) - first).alias("n_words"))


def schedule(docs: DataFrame, block: int = BLOCK_WORDS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents with size, source size and target; the mix). A row of the mix is a stretch of words of a document in a slot;
    the mix read by slot, then document number, is the training order."""
    docs = staged(sized(docs, seed))
    goals = staged(targets(docs, block))
    total = goals.agg(F.sum("n_docs"), F.sum("blocks")).first()
    laid = staged(laid_out(docs, goals, total[0] or 0))
    return laid, slots(goals, total[1] or 0).join(pieces(laid, block), ["skey", "block"])


def mix(docs: DataFrame, block: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the document in the mix), slots (in how many slots it lies), source."""
    laid, mixed = schedule(docs, block, seed)
    took = mixed.groupBy("skey", "part", "no").agg(F.sum("n_words").alias("taken"), F.countDistinct("slot").alias("slots"))
    return laid.join(took, ["skey", "part", "no"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("slots", F.lit(0)).cast("long").alias("slots"), "source")


def op5_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
