"""Secret scan with corpus-wide ownership frequency.

Every text is scanned for base patterns and for further credential shapes. The value of each candidate is hashed, and the
hashes are counted over the whole corpus by distinct repositories and owners. A value that several owners share, or that many
repositories hold, of however few owners, is a copied example (documentation, tutorials, fixtures); any other value that looks
random is reported as live.

Defined results: a null or empty text has no spans; repeated rows give repeated result rows; a null owner or repository counts
as one owner or repository of its own; rows with a null id are scanned like any other.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callstrata.llm.text import released, sliced, staged_by_few

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Shapes beyond the base patterns. The group, or else the whole match, is the credential.
FURTHER = {
    "bearer": re.compile(r"bearer\x20+([A-Za-z0-9._~+/-]{20,}=*)", re.I | re.A),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "google": re.compile(r"AIza[A-Za-z0-9_-]{35}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]+-----END [A-Z ]*PRIVATE KEY-----"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "stripe": re.compile(r"[rs]k_live_[A-Za-z0-9]{16,}"),
    "url": re.compile(r"://[A-Za-z0-9._-]{1,64}:([^\s:@/]{6,128})@[A-Za-z0-9.-]+"),
}
#: What a text holds, in lower case, if the pattern can match: a cheap test before the pattern runs.
NEEDS = {"bearer": "bearer", "github": "gh", "google": "AIza", "jwt": "eyJ", "pem": "PRIVATE KEY", "slack": "xox", "stripe": "k_live_", "url": "://"}
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, *FURTHER)
#: A value held by more owners, or in more repositories, is a copied example.
MAX_OWNERS, MAX_REPOS = 2, 20
EXAMPLE = re.compile(r"example|sample|dummy|changeme|placeholder|your|xxxx|1234567|abcdef|test", re.I | re.A)


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_live(value: str) -> bool:
    """Random enough for a credential, and without the words of an example."""
    return len(value) >= 6 and entropy(value) >= (3.0 if len(value) >= 16 else 2.5) and not EXAMPLE.search(value)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base patterns, ordered by start, then kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def further_spans(text: str) -> list[tuple[int, int, int, str]]:
    """The same of the further shapes."""
    found = []
    for k, (kind, pattern) in enumerate(FURTHER.items(), len(BASE_KINDS)):
        need = NEEDS[kind]
        if need in text or need == "bearer" and "earer" in text.lower():
            found += [(m.start(), k, m.end(), m[m.re.groups]) for m in pattern.finditer(text)]
    return sorted(found)


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value_hash", pa.string()), ("live", pa.bool_()), ("base", pa.bool_())])
SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, cands array<struct<start:long,kind:int,end:long,value_hash:string,live:boolean,base:boolean>>"


@released
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in (x for part in sliced(batch.column("text")) for x in part.to_pylist()):
            text = text or ""
            base = base_spans(text)
            n = Counter(s[1] for s in base)
            digest = hashlib.sha256(",".join(f"{BASE_KINDS[k]}:{a}:{b}" for a, k, b, _ in base).encode()).hexdigest()
            cands = [
                {"start": a, "kind": k, "end": b, "value_hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest(), "live": looks_live(v), "base": k < len(BASE_KINDS)}
                for a, k, b, v in sorted(base + further_spans(text))]
            rows.append((n[0], n[1], n[2], digest, cands))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
        arrays = [*kept, *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(SPAN))]
        yield pa.RecordBatch.from_arrays(arrays, [*(x for x in batch.schema.names if x != "text"), "n_assign", "n_access", "n_hex", "base_sha256", "cands"])


def scan(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per document: id, repository, owner, a row key, base counts, base digest and all candidates."""
    narrow = docs.select(
        F.col("doc_id"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"),
        F.xxhash64("doc_id", "text").alias("row_key"), F.col("text"))
    schema = "repo string, owner string, row_key long, " + SCANNED
    return narrow.mapInArrow(_scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def ownership(scanned: DataFrame) -> DataFrame:
    """Per value hash: occurrences, distinct repositories and owners over the corpus. Counts combine before each shuffle."""
    cand = scanned.select("repo", "owner", F.explode("cands").alias("c")).select(F.col("c.value_hash").alias("value_hash"), "repo", "owner")
    by_repo = cand.groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.sum("n").alias("n_seen"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def find_secrets(docs: DataFrame, repo: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per document; a value held by more than ``max_owners`` owners or in more than ``max_repos`` repositories is a copied example.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans (base spans, and further spans whose value is live),
    n_live, n_copied (spans by the corpus-wide verdict), max_owners and max_repos (most owners and repositories of one of its values), row_key (hash of id and text).
    """
    scanned = staged_by_few(scan(docs, repo, owner))
    verdict = ownership(scanned)
    hits = scanned.filter(F.size("cands") > 0).select("doc_id", "row_key", F.explode("cands").alias("c")).select("doc_id", "row_key", "c.*").distinct()
    names = F.array(*map(F.lit, KINDS))
    judged = hits.join(verdict, "value_hash").withColumn("copied", (F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos)).withColumn("sure", F.col("live") & ~F.col("copied"))
    per_doc = judged.groupBy("doc_id", "row_key").agg(
        F.sort_array(F.collect_list(F.when(F.col("base") | F.col("sure"), F.struct("start", "kind", "end")))).alias("all"),
        F.count_if("sure").alias("n_live"), F.count_if("copied").alias("n_copied"), F.max("n_owners").alias("max_owners"), F.max("n_repos").alias("max_repos"))
    text = F.array_join(F.transform("all", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    right = per_doc.select(F.col("doc_id").alias("r_id"), F.col("row_key").alias("r_key"), text.alias("spans"), "n_live", "n_copied", "max_owners", "max_repos")
    joined = scanned.drop("cands").join(right, scanned.doc_id.eqNullSafe(F.col("r_id")) & (scanned.row_key == F.col("r_key")), "left")
    return joined.select(
        scanned.doc_id, "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
        F.coalesce("max_owners", F.lit(0)).cast("long").alias("max_owners"), F.coalesce("max_repos", F.lit(0)).cast("long").alias("max_repos"), "row_key")


def op3_secret_ownership(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_key")
