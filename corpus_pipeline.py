"""Corpus pipeline: toxicity, near duplicates, benchmark leaks, secrets, then the mix of the sources.

Each stage works on all rows that its predecessor kept; all but the last return the columns of documents. A stage drops rows by the
hash of their id and text, so rows with a null id are judged one by one. Lists of dropped rows are broadcast only if their
counted length allows it, else joined by a shuffle.

Tables may be empty and columns null; extra columns pass through. Of repeated rows one stays, as of any near duplicates; texts
without words are duplicates of nothing and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callstrata.llm.op03_secrets import find_secrets
from callstrata.llm.op05_mixing import mix
from callstrata.llm.op06_lsh_forest import similarity_join
from callstrata.llm.op08_decontam import decontaminate, small
from callstrata.llm.op10_toxicity import score_toxicity
from callstrata.llm.text import staged


def matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of docs with (left_semi) or without (left_anti) a match in ``keys`` (row_key)."""
    keys = small(staged(keys.distinct()))
    return docs.join(keys, F.xxhash64(docs["doc_id"], docs["text"]) == keys["row_key"], how).select(*[docs[f"`{c}`"] for c in docs.columns])


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the nearest labelled examples call toxic."""
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return matched(docs, scored.filter("predicted = 1").select("row_key"), "left_anti")


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest id of each class of near duplicates."""
    found = staged(similarity_join(docs).select("row_key", "keep_key").filter("keep_key IS NOT NULL"))
    kept = matched(docs, found.filter("row_key <> keep_key").select("row_key"), "left_anti")
    repeated = staged(found.groupBy("row_key").count().filter("count > 1").select("row_key"))
    if repeated.isEmpty():
        return kept
    return matched(kept, repeated, "left_anti").union(matched(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return matched(docs, found.filter("contaminated").select("row_key"), "left_anti")


def secrets_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a live credential of their own; widely copied examples stay."""
    return matched(docs, find_secrets(docs).filter("n_live > 0").select("row_key"), "left_anti")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The share of the mix that each remaining document gives."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]
#: Trained scores and approximate candidates cannot be stated in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else staged(docs), sf_dir)
    return docs
