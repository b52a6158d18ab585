"""License scan with ordered signature rules.

Texts are brought to a form in which every word stands between spaces of its own (`` mit  license ``). Hundreds of rules, made
from hand-written license names and five forms of mention, are tried only where their keyword occurs. A detection is an
interval of words with a priority; it is suppressed if an interval of a better priority contains it. All of it is DataFrame
work: the rules are a small table with a fixed length, joined by keyword.

Defined results: a null or empty text has no words and score 0; repeated rows give repeated result rows; a mention that several
rules find alike is reported by the best priority, on a tie by each of its labels.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callstrata.llm.text import BREAKS, LOWER, UPPER, staged

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License id, versions, names. In a name `w?` is an optional word, `a|b` a choice; `{v}` stands for the version's words.
NAMES: list[tuple[str, list[str], list[str]]] = [
    ("apache-{}", ["1.0", "1.1", "2.0"], ["apache software? license|licence version|v? {v}", "asl {v}"]),
    ("gpl-{}", ["1.0", "2.0", "3.0"], ["gnu? general public license|licence version|v? {v}"]),
    ("lgpl-{}", ["2.0", "2.1", "3.0"], ["gnu? lesser|library general public license|licence version|v? {v}"]),
    ("agpl-{}", ["1.0", "3.0"], ["gnu? affero general public license|licence version|v? {v}"]),
    ("gfdl-{}", ["1.1", "1.2", "1.3"], ["gnu? free documentation license|licence version|v? {v}"]),
    ("mpl-{}", ["1.0", "1.1", "2.0"], ["mozilla public license|licence version|v? {v}"]),
    ("epl-{}", ["1.0", "2.0"], ["eclipse public license|licence version|v? {v}"]),
    ("cddl-{}", ["1.0", "1.1"], ["common development and distribution license|licence version|v? {v}"]),
    ("cpl-{}", ["1.0"], ["common public license|licence version|v? {v}"]),
    ("eupl-{}", ["1.0", "1.1", "1.2"], ["european union public licence|license version|v? {v}"]),
    ("osl-{}", ["1.0", "2.0", "2.1", "3.0"], ["open software license|licence version|v? {v}"]),
    ("afl-{}", ["1.2", "2.0", "2.1", "3.0"], ["academic free license|licence version|v? {v}"]),
    ("artistic-{}", ["1.0", "2.0"], ["perl? artistic license|licence version|v? {v}"]),
    ("ofl-{}", ["1.0", "1.1"], ["sil open font license|licence version|v? {v}"]),
    ("php-{}", ["3.0", "3.01"], ["php license|licence version|v? {v}"]),
    ("apsl-{}", ["1.0", "2.0"], ["apple public source license|licence version|v? {v}"]),
    ("lppl-{}", ["1.0", "1.2", "1.3"], ["latex project public license|licence version|v? {v}"]),
    ("cecill-{}", ["1.0", "2.0", "2.1"], ["cecill free? software? license|licence? agreement? version|v? {v}"]),
    ("odbl-{}", ["1.0"], ["open database license|licence version|v? {v}"]),
    ("mulan-{}", ["1.0", "2.0"], ["mulan permissive|psl software? license|licence version|v? {v}"]),
    ("sspl-{}", ["1.0"], ["server side public license|licence version|v? {v}"]),
    ("busl-{}", ["1.1"], ["business source license|licence version|v? {v}"]),
    ("elastic-{}", ["2.0"], ["elastic license|licence version|v? {v}"]),
    ("boost-{}", ["1.0"], ["boost software license|licence version|v? {v}"]),
    ("cc0-{}", ["1.0"], ["cc0 universal? {v} universal?", "cc0 version? {v}"]),
    *[(f"{code}-{{}}", ["1.0", "2.0", "2.5", "3.0", "4.0"], [f"{code.replace('-', ' ')} {{v}}", f"creative commons {name} {{v}}", f"creative commons {name} license|licence {{v}}"])
      for code, name in [
          ("cc-by", "attribution"), ("cc-by-sa", "attribution sharealike"), ("cc-by-nd", "attribution noderivs|noderivatives"),
          ("cc-by-nc", "attribution noncommercial"), ("cc-by-nc-sa", "attribution noncommercial sharealike"),
          ("cc-by-nc-nd", "attribution noncommercial noderivs|noderivatives")]],
    ("mit", [""], ["mit expat? license|licence", "mit x11 license|licence"]),
    ("expat", [""], ["expat license|licence"]),
    ("apache", [""], ["apache software? license|licence"]),
    ("gpl", [""], ["gnu? general public license|licence", "gnu gpl"]),
    ("lgpl", [""], ["gnu? lesser|library general public license|licence"]),
    ("agpl", [""], ["gnu? affero general public license|licence"]),
    ("mpl", [""], ["mozilla public license|licence"]),
    ("epl", [""], ["eclipse public license|licence"]),
    ("bsd-0-clause", [""], ["bsd zero|0 clause license|licence?", "zero clause bsd license|licence?"]),
    ("bsd-2-clause", [""], ["bsd 2|two clause license|licence?", "simplified bsd license|licence", "freebsd license|licence"]),
    ("bsd-3-clause", [""], ["bsd 3|three clause license|licence?", "new|modified|revised bsd license|licence"]),
    ("bsd-4-clause", [""], ["bsd 4|four clause license|licence?", "original bsd license|licence"]),
    ("bsd", [""], ["bsd license|licence"]),
    ("isc", [""], ["isc license|licence"]),
    ("zlib", [""], ["zlib libpng? license|licence"]),
    ("unlicense", [""], ["the? unlicense"]),
    ("wtfpl", [""], ["wtfpl", "do what the fuck you want to public license"]),
    ("python", [""], ["python software foundation license|licence", "psf license|licence"]),
    ("postgresql", [""], ["postgresql license|licence"]),
    ("openssl", [""], ["openssl license|licence"]),
    ("ruby", [""], ["ruby license|licence"]),
    ("vim", [""], ["vim license|licence"]),
    ("ncsa", [""], ["ncsa open? source? license|licence"]),
    ("ms-pl", [""], ["microsoft public license|licence"]),
    ("ms-rl", [""], ["microsoft reciprocal license|licence"]),
    ("public-domain", [""], ["public domain dedication", "dedicated to the public domain", "released into the public domain", "in the public domain"]),
    ("proprietary", [""], ["proprietary and confidential", "proprietary license|licence", "confidential and proprietary"]),
]
#: Grant texts: label, words.
GRANTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty"),
]
COMMON = set("license licence public software open source free the of to in and any is a common agreement version universal domain".split())
VERBS = "licensed|licenced|released|distributed|published|available|covered|provided|offered"
#: Forms of mention in order of priority (1 is best) with their score.
SPDX, NOTICE, GRANT, URL, NAME, TAG = (1, 1.0), (2, 0.95), (3, 0.9), (4, 0.85), (5, 0.8), (6, 0.6)
LEVELS = 6


def pattern(words: str) -> str:
    """Regular expression of a name over the spaced form; without look-around, so that any engine can run it."""
    out = []
    for w in words.split():
        body = "|".join(f" {a} " for a in w.rstrip("?").split("|"))
        body = f"(?:{body})" if "|" in w or w.endswith("?") else body
        out.append(body + "?" * w.endswith("?"))
    return "".join(out)


def keyword(words: str) -> str:
    """The word that a text must hold for a name to match: the longest that is neither optional, a choice nor a common word."""
    must = [w for w in words.split() if "|" not in w and not w.endswith("?")]
    return max([w for w in must if w not in COMMON and not w.isdigit()] or must, key=len)


def rules() -> list[dict]:
    """All rules: number, priority, score, label, keyword, regular expression."""
    found: list[tuple] = [(*GRANT, label, keyword(text), pattern(text)) for label, text in GRANTS]
    for code, versions, names in NAMES:
        for version in versions:
            label = code.format(version)
            ids = label.replace("-", " ").replace(".", " ")
            v = version.replace(".", " ")
            short = v.removesuffix(" 0")
            told = [n.format(v=x) for n in names for x in dict.fromkeys((v, short))]
            found.append((*SPDX, label, "spdx", pattern(f"spdx license identifier {ids}")))
            found += [(*NOTICE, label, keyword(n), pattern(f"{VERBS} under the? terms? of? the? {n}")) for n in told]
            found.append((*URL, label, "licenses", pattern(f"org licenses {ids.removeprefix('cc ')}")))
            found += [(*NAME, label, keyword(n), pattern(n)) for n in told]
            if version:
                found.append((*TAG, label, ids.split()[0], pattern(ids)))
    found = list(dict.fromkeys(found))
    return [{"rule": k, "prio": p, "conf": c, "label": lab, "kw": w, "rx": rx} for k, (p, c, lab, w, rx) in enumerate(found)]


def enclosed(text: Column) -> Column:
    """Every word between spaces of its own; an empty text is two spaces."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, BREAKS, "  ")), F.lit(" "))


def n_spaces(text: Column) -> Column:
    return F.length(text).cast("long") - F.length(F.replace(text, F.lit(" "), F.lit(""))).cast("long")


def scan(docs: DataFrame, words: list[str]) -> DataFrame:
    """One row per document with its word count, the base phrases, and its spaced text where any keyword occurs."""
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), enclosed(F.col("text")).alias("norm"))
    counted = keyed.withColumn("n_words", F.when(F.col("norm") == "  ", F.lit(0).cast("long")).otherwise((n_spaces(F.col("norm")) / 2).cast("long")))
    firsts, lasts, counts = [], [], []
    for phrase in PHRASES:
        rx, n = pattern(phrase), len(phrase.split())
        counted = counted.withColumn(f"p{len(counts)}", F.when(F.contains("norm", F.lit(rx)), F.split("norm", rx, -1)))
        parts = F.col(f"p{len(counts)}")
        counts.append(F.when(parts.isNull(), F.lit(0)).otherwise(F.size(parts) - 1).cast("long"))
        firsts.append((n_spaces(F.element_at(parts, 1)) / 2).cast("long"))
        lasts.append((F.col("n_words") - (n_spaces(F.element_at(parts, -1)) / 2) - n).cast("long"))
    labels = F.filter(F.array(*[F.when(c > 0, F.lit(label)) for c, label in zip(counts, PHRASES.values(), strict=True)]), lambda x: x.isNotNull())
    return counted.select(
        "doc_id", "row_key", "n_words", (counts[0] + counts[1] + counts[2]).alias("n_base"), F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"), labels.alias("base"), F.when(F.rlike("norm", F.lit(f" (?:{'|'.join(words)}) ")), F.col("norm")).alias("norm"))


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as a table; its length is fixed by the code."""
    kind = "array<struct<rule:int,prio:int,conf:double,label:string,kw:string,rx:string>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rules())), kind)))


def detections(scanned: DataFrame) -> DataFrame:
    """(doc_id, row_key, label, prio, conf, start, end): every place where a rule matches, in words, end exclusive."""
    spark = scanned.sparkSession
    words = sorted({r["kw"] for r in rules()})
    has = F.filter(F.array(*[F.when(F.contains("norm", F.lit(f" {w} ")), F.lit(w)) for w in words]), lambda x: x.isNotNull())
    texts = scanned.filter("norm IS NOT NULL").select("doc_id", "row_key", "norm").distinct()
    tried = texts.select("doc_id", "row_key", "norm", F.explode(has).alias("kw")).join(F.broadcast(rule_table(spark)), "kw").filter(F.expr("norm RLIKE rx"))
    cut = tried.withColumn("hits", F.regexp_extract_all("norm", F.col("rx"), 0)).withColumn("gaps", F.split("norm", F.col("rx"), -1))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("out"))
    spans = F.aggregate(
        F.zip_with(F.slice("gaps", 1, F.size("hits")), "hits", lambda g, h: F.struct((n_spaces(g) / 2).cast("long").alias("g"), (n_spaces(h) / 2).cast("long").alias("h"))),
        zero,
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + x["h"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["h"]).alias("end")))).alias("out")),
        lambda acc: acc["out"])
    return cut.select("doc_id", "row_key", "label", "prio", "conf", F.inline(spans))


def suppressed(found: DataFrame) -> DataFrame:
    """Without detections inside one of a better priority, or inside a longer one of their own, in one pass over each document's
    intervals.

    Read by start, longer first, better first, an interval lies inside an earlier one if that one's end is not before its own.
    """
    one = found.groupBy("doc_id", "row_key", "start", "end", "prio").agg(F.collect_set("label").alias("names"), F.max("conf").alias("conf"))
    order = Window.partitionBy("doc_id", "row_key").orderBy("start", F.desc("end"), "prio").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumns({f"end{p}": F.max(F.when(F.col("prio") == p, F.col("end"))).over(order) for p in range(1, LEVELS + 1)})
    inside = F.lit(False)
    for p in range(1, LEVELS + 1):
        inside = inside | ((F.col("prio") >= p) & (F.coalesce(F.col(f"end{p}"), F.lit(-1)) >= F.col("end")))
    return one.filter(~inside).drop(*[f"end{p}" for p in range(1, LEVELS + 1)])


def find_licenses(docs: DataFrame) -> DataFrame:
    """One row per document.

    n_words, n_base, first_word, last_word and base_labels state the base phrases; labels adds those of the rules; n_rules is
    the number of detections that stay; score is the best score of a rule, 0.5 if only a base phrase is there, else 0.
    """
    scanned = staged(scan(docs, sorted({r["kw"] for r in rules()})))
    kept = suppressed(detections(scanned)).groupBy("doc_id", "row_key").agg(
        F.array_distinct(F.flatten(F.collect_list("names"))).alias("found"), F.max("conf").alias("conf"), F.count("*").alias("n_rules"))
    right = kept.withColumnsRenamed({"doc_id": "r_id", "row_key": "r_key"})
    joined = scanned.drop("norm").join(right, scanned.doc_id.eqNullSafe(F.col("r_id")) & (scanned.row_key == F.col("r_key")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select(
        scanned.doc_id, "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), F.coalesce("conf", F.when(F.col("n_base") > 0, 0.5), F.lit(0.0)).alias("score"),
        F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"))


def op4_license_rules(spark, sf_dir: str) -> DataFrame:
    return find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
