"""Benchmark decontamination with a distributed positional inverted index.

The words of the training texts are stored once. Counts of all test terms over the corpus name the rarest two terms of every
test window; the positional postings of these terms are the index that is stored. The lists of the two terms are intersected
after adjusting for their distance in the item, which leaves few places; there the item is laid along the text and compared
word by word, so what is reported is exact. Places where the two terms lie within a slop of their distance are proximity matches.

Defined results: null and empty texts have no words and no hits; an item without words has no window; repeated rows give
repeated result rows; repeated items count once; an item with a null id marks words but is not counted as an item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callstrata.llm.text import BREAKS, LOWER, UPPER, staged

WINDOW = 10
SLOP = 3
#: Rows of a term or document list that may be broadcast; a longer one is joined by a shuffle.
SMALL = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS, -1), "")


def small(df: DataFrame) -> DataFrame:
    """With a broadcast hint if its counted rows are few."""
    return F.broadcast(df) if df.count() <= SMALL else df


def items_of(benchmark: DataFrame) -> DataFrame:
    """Distinct items: item_id as text, a number, their words and the window's length."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("item_words")).filter(F.size("item_words") > 0).distinct()
    return items.withColumn("item_no", F.xxhash64("item", "item_words")).withColumn("span", F.least(F.lit(WINDOW), F.size("item_words")))


def store(docs: DataFrame) -> DataFrame:
    """The stored words: one row per document, doc_id, row key, word array."""
    return staged(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), words_of(F.col("text")).alias("words")))


def term_counts(corpus: DataFrame, items: DataFrame) -> DataFrame:
    """Occurrences of every test term in all training texts; 0 for terms that never occur."""
    terms = items.select(F.explode("item_words").alias("term")).distinct()
    seen = corpus.select(F.explode("words").alias("term")).join(small(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(seen, "term", "left").fillna(0, ["n"])


def anchors(items: DataFrame, counts: DataFrame) -> DataFrame:
    """The two rarest places (a, b) of every window and the terms there, once per pair of places; a window of one word has a = b.
    Windows with a term that never occurs cannot match and are left out."""
    placed = items.select("item_no", "span", F.size("item_words").alias("n_words"), F.posexplode("item_words").alias("at", "term")).join(counts, "term")
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("span") + 1), F.least(F.col("at"), F.col("n_words") - F.col("span")))
    windows = placed.select("item_no", F.explode(starts).alias("start"), F.struct("n", "at", "term").alias("t")).groupBy("item_no", "start").agg(
        F.array_sort(F.collect_list("t")).alias("ts"))
    a, b = F.element_at("ts", 1), F.element_at("ts", F.least(F.lit(2), F.size("ts")))
    return windows.filter(a["n"] > 0).select("item_no", a["at"].alias("a"), a["term"].alias("term_a"), b["at"].alias("b"), b["term"].alias("term_b")).distinct()


def postings(corpus: DataFrame, pairs: DataFrame) -> DataFrame:
    """The stored positional index of the chosen terms: term, document, position."""
    terms = pairs.select(F.explode(F.array("term_a", "term_b")).alias("term")).distinct()
    return staged(corpus.select("doc_id", "row_key", F.posexplode("words").alias("pos", "term")).join(small(terms), "term"))


def intersect(index: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """(doc_id, row_key, item_no, shift, off): places where both terms occur; ``off`` is how far their distance is off, at most
    ``slop``; ``shift`` is the text position of the item's first word by term a."""
    wide = 2 * slop + 1
    first = index.join(small(pairs), F.col("term") == F.col("term_a")).select(
        "doc_id", "row_key", "item_no", (F.col("pos") - F.col("a")).alias("shift"), "term_b", (F.col("pos") - F.col("a") + F.col("b")).alias("due"))
    cells = F.array_distinct(F.array(F.floor((F.col("due") - slop) / wide), F.floor((F.col("due") + slop) / wide)))
    first = first.withColumn("cell", F.explode(cells))
    second = index.select(F.col("doc_id").alias("id2"), F.col("row_key").alias("key2"), F.col("term").alias("term2"), "pos", F.floor(F.col("pos") / wide).alias("cell2"))
    met = first.join(second, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("row_key") == F.col("key2")) & (F.col("term_b") == F.col("term2")) & (F.col("cell") == F.col("cell2")))
    off = F.abs(F.col("pos") - F.col("due"))
    return met.filter(off <= slop).select("doc_id", "row_key", "item_no", "shift", off.alias("off")).distinct()


def exact(corpus: DataFrame, items: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, row_key, item, start, stop): maximal stretches in which every window of the item occurs at the place."""
    at = places.filter("off = 0").drop("off")
    wanted = at.select(F.col("doc_id").alias("id2"), F.col("row_key").alias("key2")).distinct()
    texts = corpus.join(small(wanted), corpus.doc_id.eqNullSafe(F.col("id2")) & (corpus.row_key == F.col("key2")), "left_semi").distinct()
    told = at.join(small(items), "item_no").withColumnsRenamed({"doc_id": "id3", "row_key": "key3"})
    # one row per document and item with all its shifts, so that a text is carried once per item
    told = told.groupBy("id3", "key3", "item_no", "item", "item_words", "span").agg(F.collect_set("shift").alias("shifts"))
    laid = texts.join(told, F.col("doc_id").eqNullSafe(F.col("id3")) & (F.col("row_key") == F.col("key3")))
    laid = laid.withColumn("shift", F.explode("shifts")).withColumn("from", F.greatest(F.lit(0), -F.col("shift")))
    mine = F.slice("words", F.col("shift") + F.col("from") + 1, F.size("item_words") - F.col("from"))
    theirs = F.slice("item_words", F.col("from") + 1, F.size("item_words") - F.col("from"))
    same = F.array_join(F.zip_with(mine, theirs, lambda x, y: F.when(x == y, "1").otherwise("0")), "")
    rows = laid.select("doc_id", "row_key", "item", (F.col("shift") + F.col("from")).alias("base"), same.alias("same"), F.concat(F.lit("1{"), "span", F.lit(",}")).alias("rx"))
    cut = rows.filter(F.expr("same RLIKE rx")).withColumn("gaps", F.split("same", F.col("rx"), -1)).withColumn("runs", F.regexp_extract_all("same", F.col("rx"), 0))
    lengths = F.zip_with(F.slice("gaps", 1, F.size("runs")), "runs", lambda g, r: F.struct(F.length(g).alias("g"), F.length(r).alias("r")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
    spans = F.aggregate(
        lengths, zero,
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + x["r"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["r"]).alias("stop")))).alias("out")),
        lambda acc: acc["out"])
    return cut.select("doc_id", "row_key", "item", "base", F.inline(spans)).select(
        "doc_id", "row_key", "item", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("stop")).alias("stop"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items with a proximity match and
    no exact one), row_key (hash of id and text)."""
    items = staged(items_of(benchmark))
    corpus = store(docs)
    pairs = staged(anchors(items, term_counts(corpus, items)))
    places = staged(intersect(postings(corpus, pairs), pairs, slop))
    found = staged(exact(corpus, items, places))
    before = Window.partitionBy("doc_id", "row_key").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("stop").over(before), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", seen))
    hit = found.select("doc_id", "row_key", "start", "stop").distinct().withColumn("fresh", fresh).groupBy("doc_id", "row_key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = found.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set("item")).alias("item_list"))
    near = places.join(small(items.select("item_no", "item")), "item_no").groupBy("doc_id", "row_key").agg(F.collect_set("item").alias("near"))
    out = corpus.select("doc_id", "row_key", F.size("words").cast("long").alias("n_words"))
    for k, part in enumerate((hit, named, near)):
        part = part.withColumnsRenamed({"doc_id": f"id{k}", "row_key": f"key{k}"})
        out = out.join(part, F.col("doc_id").eqNullSafe(F.col(f"id{k}")) & (F.col("row_key") == F.col(f"key{k}")), "left").drop(f"id{k}", f"key{k}")
    none = F.array().cast("array<string>")
    listed = F.coalesce("item_list", none)
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.size(F.array_except(F.coalesce("near", none), listed)).cast("long").alias("n_near"), "row_key")


def op8_positional_index(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row_key")


ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT row_number() OVER () AS ino, * FROM (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL)),
ws AS (SELECT ino, item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM ws),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n)),
m AS (SELECT DISTINCT rid, item, p, n FROM dw JOIN bw USING (n, g)),
h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM m)) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid),
post AS (SELECT rid, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM d),
cnt AS (SELECT term, count(*) AS c FROM post GROUP BY term),
wt AS (SELECT ino, item, p, unnest(range(p, p + n)) AS spot, unnest(w[p:p + n - 1]) AS term FROM ws),
rk AS (SELECT wt.*, coalesce(c, 0) AS c, row_number() OVER (PARTITION BY ino, p ORDER BY coalesce(c, 0), spot) AS r, count(*) OVER (PARTITION BY ino, p) AS k FROM wt LEFT JOIN cnt USING (term)),
pr AS (SELECT DISTINCT a.ino, a.item, a.spot AS pa, a.term AS ta, z.spot AS pb, z.term AS tb FROM rk a JOIN rk z USING (ino, p) WHERE a.r = 1 AND z.r = least(2, a.k) AND a.c > 0),
nr AS (SELECT rid, count(*) AS n_near FROM (
         SELECT DISTINCT x.rid, pr.item FROM pr JOIN post x ON x.term = ta JOIN post y ON y.term = tb AND y.rid = x.rid AND abs(y.pos - x.pos - pb + pa) <= 3
         EXCEPT SELECT rid, item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (rid) LEFT JOIN i USING (rid) LEFT JOIN nr USING (rid)
"""
