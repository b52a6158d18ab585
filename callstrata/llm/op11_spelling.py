"""Spelling variants by Bloom-guided neighbourhoods.

Words are counted per task before they meet. The vocabulary goes into blocked Bloom filters, one shard per length, which are broadcast. Every
word then makes its edits as hashes, without spelling them: all deletions, which reach the shard one shorter, and all replacements of
a letter by a later one, which reach its own. Insertions and replacements by an earlier letter are the same pairs seen from the other word.
Only edits that the filters may hold are spelled out, shuffled and joined exactly with the vocabulary, which removes what the filters let through in error.

A hash of a word is a sum over its letters and places, so an edit's hash is found from partial sums. The filters have at most ``WORDS`` words of 64
bits at any size of the vocabulary, which bounds the broadcast; a larger vocabulary lets more false edits through, and the join still removes them.

A word has at most (letters + 1) x length neighbours, whatever the table holds, so no group grows with the rows. A word's form has five
times its count or more, so paths of forms are short; they are followed by doubling steps.

Defined results: null and empty texts have no words; a null id is written ``null`` in the hash; texts and words of any length are read whole; repeated rows count
again; ties of n go to the smaller word in code-point order; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callstrata.llm.text import LOWER, UPPER, batches_of_bytes, read, staged

LETTERS = 6
OCCURRENCES = 5
RATIO = 5
PERIOD = 199
#: Most words of all filters together (64 bits each), and the least of a shard.
WORDS, LEAST = 1 << 22, 1 << 8
#: Lengths from which words share shards.
LONG = 64
#: Counts that a task holds before it passes them on, and probes at a time.
HELD, PROBES = 400_000, 1 << 20
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def runs(text: bytes, doc_id: str) -> Iterator[tuple[str, int]]:
    """Words of a text of at least ``LETTERS`` code points with their number, after the thinning by the hash of id and run."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(re.findall(rf"[a-zÀ-ÿ]{{{LETTERS},}}", text.translate(_LOWER).decode())).items():
        h = zlib.crc32(run.encode(), start)
        if h % PERIOD == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < LETTERS:
                continue
        yield run, n


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) with the counts of this task's texts."""
    held: Counter = Counter()

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for name, text in zip(batch.column("name").to_pylist(), batches_of_bytes(batch.column("text")), strict=True):
            if text:
                for word, n in runs(text, name):
                    held[word] += n
            if len(held) > HELD:
                yield told()
                held.clear()
    yield told()


def vocabulary(docs: DataFrame, least: int = OCCURRENCES) -> DataFrame:
    """(word, n): every word with at least ``least`` occurrences in all texts."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("name"), "text")
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def stir(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def places(at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of letters at places; a word's hash is the sum of these."""
    with np.errstate(over="ignore"):
        return stir(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + codes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))


def shard(length) -> np.ndarray:
    return np.where(np.asarray(length) < LONG, length, LONG + np.asarray(length) % LONG)


class Filters:
    """Blocked Bloom filters of all shards in one array. A word has one 64-bit block and a bit in each quarter of it."""

    def __init__(self, sizes: dict[int, int], words: int = WORDS):
        """sizes: words by shard; there are at most 2 x ``LONG`` shards."""
        share = max(1.0, sum(max(LEAST, n) for n in sizes.values()) * 2 / words)
        self.first, self.size = np.zeros(2 * LONG, np.int64), np.zeros(2 * LONG, np.int64)
        total = 0
        for s in sorted(sizes):
            self.first[s], self.size[s] = total, 1 << max(0, int(max(LEAST, sizes[s]) / share).bit_length() - (share > 1))
            total += int(self.size[s])
        self.total, self.blocks = total, None

    def at(self, h: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Block number and bits of the hashes of a shard."""
        h = stir(h)
        block = self.first[s] + (h & np.uint64(self.size[s] - 1)).astype(np.int64)
        mask = np.zeros(len(h), np.uint64)
        for quarter in range(4):
            mask |= np.uint64(1) << (np.uint64(16 * quarter) + ((h >> np.uint64(44 + 4 * quarter)) & np.uint64(15)))
        return block, mask.view(np.int64)

    def holds(self, h: np.ndarray, s: int) -> np.ndarray:
        if not self.size[s]:
            return np.zeros(len(h), bool)
        block, mask = self.at(h, s)
        return self.blocks[block] & mask == mask


def code_matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def by_length(words: list[str]) -> dict[int, np.ndarray]:
    """Row numbers of the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    return {int(sizes[part[0]]): part for part in np.split(order, cuts) if len(part)}


def filled(vocab: DataFrame, words: int = WORDS) -> Filters:
    """The filters of a vocabulary. Each task tells the bits it sets; together there are at most ``words`` blocks."""
    length = F.length("word")
    sizes = {r["s"]: r["n"] for r in vocab.groupBy(F.when(length < LONG, length).otherwise(LONG + length % LONG).alias("s")).agg(F.count("*").alias("n")).collect()}
    empty = Filters(sizes, words)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(empty.total, np.int64)
        for batch in batches:
            terms = batch.column("word").to_pylist()
            for size, rows in by_length(terms).items():
                step = max(1, PROBES // size)
                for k in range(0, len(rows), step):
                    codes = code_matrix([terms[i] for i in rows[k:k + step]])
                    with np.errstate(over="ignore"):
                        h = places(np.arange(size)[None, :], codes).sum(axis=1, dtype=np.uint64)
                    block, mask = empty.at(h, int(shard(size)))
                    np.bitwise_or.at(own, block, mask)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own[at])], ["block", "bits"])

    told = vocab.select("word").mapInArrow(fill, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    empty.blocks = np.zeros(empty.total, np.int64)
    empty.blocks[told.column("block").to_numpy()] = told.column("bits").to_numpy()
    return empty


def probes(words: list[str], size: int, filters: Filters, letters: np.ndarray) -> Iterator[tuple[int, str]]:
    """(index of a word, edit) for the deletions and the replacements by a later letter that the filters may hold. The words have one length."""
    codes = code_matrix(words)
    at = np.arange(size)[None, :]
    s, shorter = int(shard(size)), int(shard(size - 1))
    with np.errstate(over="ignore"):
        own = places(at, codes)
        moved = places(at - 1, codes)  # each letter one place to the left
        total = own.sum(axis=1, dtype=np.uint64)
        before, after = np.zeros(len(words), np.uint64), moved.sum(axis=1, dtype=np.uint64)
        for i in range(size):
            after = after - moved[:, i]
            new = i == 0 or codes[:, i] != codes[:, i - 1]  # of equal neighbours the first is deleted
            for w in np.flatnonzero(filters.holds(before + after, shorter) & new):
                yield int(w), words[w][:i] + words[w][i + 1:]
            before = before + own[:, i]
            there = places(np.full(len(letters), i), letters)
            rest = total - own[:, i]
            step = max(1, PROBES // max(1, len(letters)))
            for k in range(0, len(words), step):
                w, c = np.nonzero(codes[k:k + step, i, None] < letters[None, :])
                hit = filters.holds(rest[k + w] + there[c], s)
                for x, y in zip((k + w[hit]).tolist(), c[hit].tolist(), strict=True):
                    yield x, words[x][:i] + chr(letters[y]) + words[x][i + 1:]


def near_pairs(vocab: DataFrame, filters_words: int = WORDS) -> DataFrame:
    """(word, n, near, near_n), every pair of near words in both directions. ``vocab`` is a written table."""
    rows = vocab.count()
    letters = np.array(sorted(ord(r[0]) for r in vocab.select(F.explode(F.split("word", ""))).distinct().collect() if r[0]), np.uint32)  # of 90 at most
    sent = vocab.sparkSession.sparkContext.broadcast(filled(vocab, filters_words).__dict__)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters.__new__(Filters)
        filters.__dict__.update(sent.value)
        out: list[list] = [[], [], []]

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["word", "n", "edit"])

        for batch in batches:
            terms, ns = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for size, part in by_length(terms).items():
                step = max(1, PROBES // size)
                for k in range(0, len(part), step):
                    nos = part[k:k + step]
                    for w, edit in probes([terms[i] for i in nos], size, filters, letters):
                        for column, value in zip(out, (terms[nos[w]], ns[nos[w]], edit), strict=True):
                            column.append(value)
                        if len(out[0]) >= 10_000:
                            yield told()
                            out = [[], [], []]
        yield told()

    spread = vocab.repartition(max(1, -(-rows // 10_000)), "word")
    found = spread.mapInArrow(probe, "word string, n long, edit string")
    met = staged(found.join(vocab.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit"))
    there = met.select("word", "n", F.col("edit").alias("near"), F.col("edit_n").alias("near_n"))
    return there.unionAll(met.select(F.col("edit"), F.col("edit_n"), F.col("word"), F.col("n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last. A form has a larger n than its word, so there are no circles."""
    at = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        beyond = at.select(F.col("word").alias("mid"), F.col("root").alias("further"))
        met = staged(at.join(beyond, at["root"] == beyond["mid"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = met.select("word", "root")
        if met.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, ratio: int = RATIO, least: int = OCCURRENCES, filters_words: int = WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    vocab = staged(vocabulary(docs, least))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_pairs(vocab, filters_words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    chosen = -F.col("best.less") >= ratio * F.col("n")
    near = staged(near.select("word", "n_near", F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n")))
    last = roots(near.filter("form IS NOT NULL"))
    out = vocab.join(near, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))


def op11_bloom_variants(spark, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))
