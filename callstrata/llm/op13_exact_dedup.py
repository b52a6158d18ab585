"""Exact duplicates by two passes over a Bloom filter.

A text's digest is the SHA-256 of its normal form (A-Z lower-cased, nothing else). The first pass sets the bits of every digest and
keeps the bits that were set more than once, inside each task and then over all tasks; a digest whose bits are not all among these
stands alone. The second pass tests every row against those bits: only rows that may be repeated are shuffled and counted by their
whole digest, which removes what the filter let through in error; the rest pass straight to the result.

The filter is made of 64-bit words and a digest lies in one of them, with one bit in each quarter. It has at most ``WORDS`` words at any size
of the table, so its broadcast is bounded; a table that outgrows it has more rows that may be repeated, never a wrong result. No text is shuffled.

A group may hold any share of the rows. Its rows are counted map-side; groups of ``HOT`` rows or more (at most 100,000 of them, as
the bound rises with the table) meet their rows by a broadcast, all others by a shuffled join.

Defined results: null counts as the empty text; the row with the largest id stays, a null id being smaller than any other, and of
repeated rows of that id one stays; texts of any length are read whole; extra columns are neither read nor returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callstrata.llm.text import LOWER, UPPER, read, staged

#: Most words of the filter (64 bits each).
WORDS = 1 << 21
#: Rows from which a group counts as hot.
HOT = 10_000


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the normal form in UTF-8."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256)


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, row_no (differs for every row), digest (32 bytes), h (64 bits of it)."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row_no"), F.unhex(digest(F.col("text"))).alias("digest"))
    return rows.withColumn("h", F.xxhash64("digest"))


def filter_words(rows: int) -> int:
    """A power of two: four digests to a word, up to ``WORDS`` words."""
    return min(WORDS, 1 << max(10, (rows // 4).bit_length()))


def bits(h: Column, words: int) -> tuple[Column, Column]:
    """The word of a hash, and its four bits in there."""
    lanes = [F.expr(f"shiftleft(1L, {16 * k} + cast(shiftrightunsigned(h, {40 + 4 * k}) & 15 AS int))") for k in range(4)]
    return h.bitwiseAND(words - 1).cast("int"), lanes[0].bitwiseOR(lanes[1]).bitwiseOR(lanes[2]).bitwiseOR(lanes[3])


def marked(words: int):
    """Per task, (word, once, twice): the bits that its rows set, and those that they set again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(words, np.int64), np.zeros(words, np.int64)
        for batch in batches:
            word = batch.column("word").to_numpy()
            mask = batch.column("mask").to_numpy()
            for quarter in range(4):
                lane = mask & np.int64(np.uint64(0xFFFF << 16 * quarter).astype(np.int64))
                order = np.lexsort((lane, word))
                w, b = word[order], lane[order]
                again = np.zeros(len(w), bool)
                again[1:] = (w[1:] == w[:-1]) & (b[1:] == b[:-1])
                again |= (once[w] & b) != 0
                np.bitwise_or.at(twice, w[again], b[again])
                np.bitwise_or.at(once, w, b)
        at = np.flatnonzero(once)
        for k in range(0, len(at), 65_536):
            part = at[k:k + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(once[part]), pa.array(twice[part])], ["word", "once", "twice"])

    return run


def repeated_bits(rows: DataFrame, words: int) -> DataFrame:
    """(word, twice): the bits that more than one row sets; at most ``words`` rows. A task gives a word once, so a word's list is no longer than the number of tasks."""
    word, mask = bits(F.col("h"), words)
    told = rows.select(word.alias("word"), mask.alias("mask")).mapInArrow(marked(words), "word int, once long, twice long")
    seen = "aggregate(collect_list(once), named_struct('o', 0L, 't', 0L), (a, x) -> named_struct('o', a.o | x, 't', a.t | (a.o & x))).t"
    return told.groupBy("word").agg(F.bit_or("twice").alias("in_task"), F.expr(seen).alias("between")).select(
        "word", F.col("in_task").bitwiseOR(F.col("between")).alias("twice")).filter("twice <> 0")


def exact_groups(docs: DataFrame, words: int | None = None, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, possible (the filter could not tell that it stands alone)."""
    rows = staged(hashed(docs))
    total = rows.count()
    words = words or filter_words(total)
    twice = staged(repeated_bits(rows, words))
    word, mask = bits(F.col("h"), words)
    tested = rows.withColumn("word", word).withColumn("mask", mask).join(F.broadcast(twice), "word", "left")
    tested = tested.select("doc_id", "row_no", "digest", (F.coalesce(F.col("twice"), F.lit(0)).bitwiseAND(F.col("mask")) == F.col("mask")).alias("possible"))
    alone = tested.filter(~F.col("possible")).withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})

    maybe = staged(tested.filter("possible"))
    last = F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "row_no")).alias("last")
    groups = staged(maybe.groupBy("digest").agg(F.count("*").alias("group_size"), last))
    facts = groups.select(F.col("digest").alias("of"), "group_size", F.col("last.doc_id").alias("keep_id"), F.col("last.row_no").alias("keep_row"))
    least = max(hot, total // 100_000)
    large = F.broadcast(facts.filter(F.col("group_size") >= least))
    met = maybe.join(large, maybe["digest"] == large["of"], "left")
    common = met.filter("of IS NOT NULL").drop("of")
    rest = met.filter("of IS NULL").select("doc_id", "row_no", "digest", "possible").join(facts.filter(F.col("group_size") < least), F.col("digest") == F.col("of")).drop("of")
    joined = common.unionByName(rest).withColumn("kept", F.col("row_no") == F.col("keep_row")).drop("keep_row")
    return alone.unionByName(joined).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "possible")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows with the same id and the same normal form, one."""
    lost = exact_groups(docs).filter("NOT kept AND (keep_id IS NULL OR NOT doc_id <=> keep_id)").select(F.col("doc_id").alias("lost_id"), F.col("text_sha256").alias("lost_sha")).filter("lost_id IS NOT NULL")
    tagged = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), digest(docs["text"]).alias("sha"))
    left = tagged.join(lost, (F.col("row.doc_id") == F.col("lost_id")) & (F.col("sha") == F.col("lost_sha")), "left_anti")
    return left.select("row.*")


def op13_bloom_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents")).drop("possible")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
"""
