"""Toxicity by the nearest labelled examples.

A bounded sample of labelled training texts gives the examples; the vector space is made of all their terms, weighed by TF-IDF with
document frequencies counted over all texts. A text's nearest examples by cosine are found exactly in a block-max inverted index: the postings
of its rarer terms are added up, the frequent ones only bound what each block of examples can still reach, and blocks whose bound
stays below the k-th best are skipped. The neighbours vote with the square of their cosine, corrected for the sampling of the classes.

Terms far more frequent in toxic examples than in clean ones are marks. Their log odds are a second feature beside the vote: a monotone fit
turns the sum of both into a probability, apart for texts without a mark, with a single occurrence of one, with more, and for
texts with the very vector of an example, which such examples alone judge. A term counts once per context (its neighbour words at its first
place in a text), so copies of a text and passages that many texts share do not make their terms marks.

No label decides its own row. Training texts fall into ``FOLDS`` folds by the hash of the text; a text that is not held out is judged by
a model (examples, class sizes, marks, fits) without its own fold, so neither its label nor a label of an equal text is an
input; held-out texts are judged by the model of all folds. Apart from that a score depends on the text alone: equal vectors of a fold have equal scores.

Parameters that bound the fit: at most ``EXAMPLES`` different labelled texts of class 0 and 1, with at most ``POSTINGS`` terms together, ``MARKS`` marks;
the index that is broadcast is bounded by them, whatever the length of the texts.

Defined results: a null or empty text, or one without any word of an example, gets the toxic share of such training texts;
without labels of both classes every score is the share of toxic labels, or 0.5 without labels; of several labels of an id the
largest counts; labels that are null or neither 0 nor 1 are ignored; texts of any length are read whole; ties of cosine go to the smaller text
hash; repeated rows give repeated result rows; an empty table gives no rows; extra columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callstrata.llm.text import batches_of_bytes, byte_words, give_back, read, released, staged, staged_by_few

EXAMPLES = (3_000, 1_500)
POSTINGS = 4_000_000
MARKS = 1024
LIFT = 3.0
K = 25
FOLDS = 4
THRESHOLD = 0.7
#: Examples of a block of the index; terms whose postings are bounded by blocks, and the share of the examples that makes a term frequent.
BLOCK, FREQUENT, SHARE = 32, 512, 1 / 32
#: Texts that are searched together.
CHUNK = 64
#: Rows below which an amount of evidence has no fit of its own.
LEAST_ROWS = 20


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


class TermHash(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)
        return h


# --- examples ----------------------------------------------------------------------------------


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, fold, y, n, doc_id): the different labelled training texts, how many rows carry each with that label, and the smallest of their ids."""
    rows = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    keys = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", text_key(F.col("text")).alias("key"))
    return keys.join(rows, "doc_id").groupBy("key", "y").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).withColumn(
        "fold", F.pmod("key", F.lit(FOLDS)).cast("int"))


def sampled(texts: DataFrame, per_class: tuple[int, int]) -> tuple[DataFrame, np.ndarray]:
    """At most ``per_class`` training texts, evenly from the folds and in the order of their hashes; and the number of all by fold and class."""
    sizes = np.zeros((FOLDS, 2))
    for r in texts.groupBy("fold", "y").agg(F.count("*").alias("n")).collect():
        sizes[r["fold"], r["y"]] = r["n"]
    parts = [texts.filter((F.col("fold") == f) & (F.col("y") == y)).orderBy(F.xxhash64("key"), "key").limit(-(-per_class[y] // FOLDS)) for f in range(FOLDS) for y in (0, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return staged(out), sizes


@released
def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = TermHash()
    for batch in batches:
        lists: list[list] = [[], [], []]
        for text in batches_of_bytes(batch.column("text")):
            words = byte_words(text)
            first = {w: i for i, w in zip(range(len(words) - 1, -1, -1), reversed(words))}
            counts = Counter(words)
            words.append(b"")
            lists[0].append([known[w] for w in first])
            lists[1].append([counts[w] for w in first])
            lists[2].append([zlib.crc32(words[i - 1] + b" " + words[i + 1]) for i in first.values()])
        arrays = [batch.column(c) for c in ("key", "fold", "y", "n", "doc_id", "text")]
        yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(x, pa.list_(pa.int64())) for x in lists)], ["key", "fold", "y", "n", "doc_id", "text", "terms", "counts", "contexts"])


def spelled(docs: DataFrame, sample: DataFrame, postings: int = POSTINGS) -> DataFrame:
    """The sample with each text, its different terms (hashes) and their counts and contexts. The last texts of a fold and class are
    left out where the terms before them use up its part of ``postings``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    few = F.broadcast(sample.withColumnRenamed("doc_id", "id2"))
    texts = docs.select(F.col("doc_id").alias("own"), text_key(F.col("text")).alias("own_key"), "text")
    found = texts.join(few, (F.col("own") == F.col("id2")) & (F.col("own_key") == F.col("key"))).groupBy("key", "fold", "y", "n", F.col("id2").alias("doc_id")).agg(F.first("text").alias("text"))
    rows = staged_by_few(found.mapInArrow(_spelled, f"key long, fold int, y int, n long, doc_id {kind}, text string, terms array<long>, counts array<long>, contexts array<long>"))
    room = postings // (2 * FOLDS)
    used = "sum(size(terms)) OVER (PARTITION BY fold, y ORDER BY xxhash64(key), key ROWS UNBOUNDED PRECEDING)"
    place = "row_number() OVER (PARTITION BY fold, y ORDER BY xxhash64(key), key)"
    kept = rows.select("key", "y", "fold", F.size("terms").alias("s"), "terms").selectExpr("key AS k2", "y AS y2", f"{used} AS used", f"{place} AS place").filter(f"used <= {room} OR place = 1")
    return rows.join(F.broadcast(kept.select("k2", "y2")), (F.col("key") == F.col("k2")) & (F.col("y") == F.col("y2"))).drop("k2", "y2")


def models_of() -> list[int]:
    """Numbers of the models: one without each fold, and ``FOLDS``, the one of all folds."""
    return list(range(FOLDS + 1))


def inside(model: int, folds) -> np.ndarray:
    """Whether a model learns from these folds."""
    return np.asarray(folds) != model


def marked_terms(examples: DataFrame, texts: np.ndarray, size: int = MARKS) -> dict[int, dict[int, float]]:
    """Per model the marks (term hash: log odds), the first ``size`` by falling log-likelihood ratio. ``texts``: number of example texts by fold and class."""
    flat = examples.select("y", "fold", F.explode(F.arrays_zip("terms", "contexts")).alias("t"))
    seen = flat.groupBy("y", F.col("t.terms").alias("term"), F.col("t.contexts").alias("context")).agg(F.bit_or(F.expr("shiftleft(1, fold)")).alias("folds"))
    counts, picks = [], {}
    for m in models_of():
        own = sum(1 << f for f in range(FOLDS) if f != m)
        for y in (0, 1):
            counts.append(F.count_if((F.col("y") == y) & (F.col("folds").bitwiseAND(own) != 0)).alias(f"n{y}_{m}"))
    table = seen.groupBy("term").agg(*counts)
    table = staged(table)
    least = 2 * np.log(max(2, table.count()))  # by chance less than one of so many terms has so large a ratio
    for m in models_of():
        n0, n1 = texts[inside(m, range(FOLDS))].sum(axis=0)
        if not n0 or not n1:
            picks[m] = {}
            continue
        # no term that is more frequent in clean texts, or in one toxic text only
        some = table.select("term", F.col(f"n0_{m}").alias("b"), F.col(f"n1_{m}").alias("a")).filter((F.col("a") > 1) & (F.col("a") / float(n1) >= LIFT * (F.col("b") + 0.5) / (float(n0) + 0.5))).toArrow()
        term, a, b = (some.column(c).to_numpy().astype(t) for c, t in (("term", np.int64), ("a", float), ("b", float)))
        total, g2 = n0 + n1, np.zeros(len(term))
        for got, rows, both in ((a, n1, a + b), (b, n0, a + b), (n1 - a, n1, total - a - b), (n0 - b, n0, total - a - b)):
            due = both * rows / total
            with np.errstate(divide="ignore", invalid="ignore"):
                g2 += np.where(got > 0, 2 * got * np.log(got / due), 0.0)
        odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
        best = np.lexsort((term, -g2))
        best = best[g2[best] >= least][:size]
        picks[m] = dict(zip(term[best].tolist(), odds[best].tolist(), strict=True))
    return picks


def names_of(examples: DataFrame, wanted: set[int]) -> dict[int, str]:
    """Words of the wanted term hashes."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = TermHash(), {}
        for batch in batches:
            for text in batches_of_bytes(batch.column("text")):
                out |= {known[w]: w for w in set(byte_words(text)) if known[w] in wanted}
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array([w.decode("utf-8", "replace") for w in out.values()], pa.string())], ["term", "word"])

    if not wanted:
        return {}
    return {r["term"]: r["word"] for r in examples.filter("y = 1").select("text").mapInArrow(run, "term long, word string").groupBy("term").agg(F.min("word").alias("word")).collect()}


# --- vectors of all texts ----------------------------------------------------------------------


def vectors(docs: DataFrame, vocab: np.ndarray) -> DataFrame:
    """doc_id, held_out, row_key, fold, terms (numbers in the vocabulary, rising), counts, other (words outside of it) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known = sent.value, TermHash()
        for batch in batches:
            at, n, other = [], [], []
            for text in batches_of_bytes(batch.column("text")):
                found = Counter(byte_words(text))
                terms = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
                counts = np.fromiter(found.values(), np.int32, len(found))
                no = np.minimum(np.searchsorted(vocab, terms), max(0, len(vocab) - 1))
                ours = vocab[no] == terms if len(vocab) else np.zeros(len(terms), bool)
                order = np.argsort(no[ours], kind="stable")
                at.append(no[ours][order].astype(np.int32))
                n.append(counts[ours][order])
                other.append(int(counts[~ours].sum()))
            keep = ["doc_id", "held_out", "row_key", "fold"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32())), pa.array(other, pa.int64())], [*keep, "terms", "counts", "other"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    key = text_key(F.col("text"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.xxhash64("doc_id", "text").alias("row_key"), F.pmod(key, F.lit(FOLDS)).cast("int").alias("fold"), "text")
    return rows.mapInArrow(count, f"doc_id {kind}, held_out boolean, row_key long, fold int, terms array<int>, counts array<int>, other long")


# --- the index ---------------------------------------------------------------------------------


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of a text's terms, of length one."""
    w = (1.0 + np.log(counts)) * idf
    return w / np.sqrt((w * w).sum())


class Index:
    """Block-max inverted index over the examples.

    Postings of the rarer terms lie as lists; those of the ``FREQUENT`` most frequent ones as rows, with the largest
    weight of every block of ``BLOCK`` examples. Examples with the same frequent words lie near each other, which tightens the bounds.
    """

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray, order: np.ndarray):
        """``order``: text hashes, which decide ties."""
        self.n = len(terms)
        ends = np.cumsum([0, *(len(t) for t in terms)])
        parts = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        flat, weight = np.empty(ends[-1], np.int32), np.empty(ends[-1])
        for p, t, c in zip(parts, terms, counts, strict=True):
            if len(t):
                flat[p], weight[p] = t, weighed(c.astype(float), idf[t])
        df = np.bincount(flat, minlength=len(idf))
        often = np.argsort(-df, kind="stable")[:FREQUENT]
        often = often[df[often] > max(8, SHARE * self.n)]
        self.row = np.full(len(idf), -1)
        self.row[often] = np.arange(len(often))
        heavy = np.zeros(len(idf), bool)
        heavy[often] = True
        heavy = heavy[flat]
        lead = np.full(self.n, -1)  # the heaviest frequent term of an example, of equal ones the last
        for i, p in enumerate(parts):
            t, w = flat[p][heavy[p]], weight[p][heavy[p]]
            if len(t):
                lead[i] = t[np.flatnonzero(w == w.max())[-1]]
        self.old = np.lexsort((order, lead))  # number here -> number given
        new = np.empty(self.n, np.int32)
        new[self.old] = np.arange(self.n, dtype=np.int32)
        self.rank = np.argsort(np.argsort(order[self.old], kind="stable"), kind="stable")
        self.width = -(-max(1, self.n) // BLOCK) * BLOCK
        self.dense = np.zeros((len(often), self.width))
        for i, p in enumerate(parts):
            self.dense[self.row[flat[p][heavy[p]]], new[i]] = weight[p][heavy[p]]
        self.bound = self.dense.reshape(len(often), self.width // BLOCK, BLOCK).max(axis=2)
        owner = np.repeat(new, np.diff(ends))[~heavy]
        flat, weight = flat[~heavy], weight[~heavy]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(idf)))])
        rare = np.argsort(flat, kind="stable").astype(np.int32)
        self.nos, self.weight = owner[rare], weight[rare]
        self.idf = idf
        self.opened_blocks = self.all_blocks = 0

    def barred(self, folds: np.ndarray, *without: int) -> np.ndarray:
        """Places of the index that a search must not find: those of the folds, and the padding."""
        out = np.ones(self.width, bool)
        out[:self.n] = np.isin(folds[self.old], without)
        return out

    def opened(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What all searches of these texts (terms, counts) share: sums over their rarer terms, weights of their frequent
        terms, and what the frequent ones can add to each block at most."""
        part, often = np.zeros((len(texts), self.width)), np.zeros((len(texts), len(self.dense)))
        for k, (terms, counts) in enumerate(texts):
            w = weighed(counts.astype(float), self.idf[terms])
            row = self.row[terms]
            rare = row < 0
            often[k, row[~rare]] = w[~rare]
            t, v = terms[rare], w[rare]
            first, size = self.start[t], self.start[t + 1] - self.start[t]
            at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
            part[k] = np.bincount(self.nos[at], self.weight[at] * np.repeat(v, size), self.width)
        return part, often, often @ self.bound

    def nearest(self, opened: tuple, k: int, barred: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text the numbers (as given) and cosines of the k nearest examples with a positive cosine that are not barred (texts x
        places), nearest first, ties to the smaller hash.

        The blocks of the highest bounds are added up first; then those that may still hold one of the k best of any text. Texts that
        are searched together should be alike, so that they need the same blocks.
        """
        part, often, more = opened
        m, n_blocks = more.shape
        top = np.where(barred, -1.0, part).reshape(m, n_blocks, BLOCK).max(axis=2)
        bound = np.where(top < 0, -1.0, top + more)
        scores = np.full((m, self.width), -1.0)
        done = np.zeros(n_blocks, bool)
        ahead = min(n_blocks, -(-2 * k // BLOCK) + 2)
        wanted = np.zeros(n_blocks, bool)
        wanted[np.argpartition(bound, n_blocks - ahead, axis=1)[:, n_blocks - ahead:]] = True
        while wanted.any():
            blocks = np.flatnonzero(wanted)
            if len(blocks) > n_blocks // 2:
                sums = often @ self.dense
                sums += part
                at = np.repeat(wanted, BLOCK)
                np.copyto(scores, sums, where=at & ~barred)
            else:
                for some in np.split(blocks, range(16, len(blocks), 16)):
                    at = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                    scores[:, at] = np.where(barred[:, at], -1.0, part[:, at] + often @ self.dense[:, at])
            done[blocks] = True
            least = np.partition(scores, self.width - k, axis=1)[:, self.width - k] if self.width > k else np.full(m, -1.0)
            wanted = (bound >= np.maximum(least, 0.0)[:, None] - 1e-11).any(axis=0) & ~done
        self.opened_blocks, self.all_blocks = self.opened_blocks + int(done.sum()), self.all_blocks + n_blocks
        out = []
        for row, floor in zip(scores, least, strict=True):
            nos = np.flatnonzero(row >= max(floor - 1e-11, 1e-12))
            cos = np.round(row[nos], 12)
            best = np.lexsort((self.rank[nos], -cos))[:k]
            out.append((self.old[nos[best]], cos[best]))
        return out


# --- votes and fits ----------------------------------------------------------------------------


def vote(cosines: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Share of the votes for toxic, each the square of a cosine times its weight."""
    w = cosines * cosines * weight
    return float((w * (y == 1)).sum() / w.sum()) if w.sum() > 0 else 0.0


def log_odds(share: float, least: float = 0.02) -> float:
    share = min(max(share, least), 1 - least)
    return float(np.log(share / (1 - share)))


def monotone(x: list[float], y: list[int], weight: list[float], prior: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: lower ends of the steps and their values, smoothed by two rows of the share ``prior``."""
    steps: list[list[float]] = []
    for a, b, w in sorted(zip(x, y, weight, strict=True)):
        if steps and steps[-1][0] == a:
            steps[-1][1] += b * w
            steps[-1][2] += w
        else:
            steps.append([a, b * w, w])
    pooled: list[list[float]] = []
    for s in steps:
        pooled.append(s)
        while len(pooled) > 1 and pooled[-2][1] * pooled[-1][2] >= pooled[-1][1] * pooled[-2][2]:
            last = pooled.pop()
            pooled[-1][1] += last[1]
            pooled[-1][2] += last[2]
    return np.array([s[0] for s in pooled]), np.array([(s[1] + 2.0 * prior) / (s[2] + 2.0) for s in pooled])


class Judge:
    """The examples, their index and what each model makes of them; built in a task from plain arrays."""

    def __init__(self, plain: dict):
        self.__dict__.update(plain)
        ends = np.cumsum(self.sizes)
        parts = [slice(b - n, b) for b, n in zip(ends, self.sizes, strict=True)]
        self.index = Index([self.terms[p] for p in parts], [self.counts[p] for p in parts], self.idf, self.key)
        self.masks: dict[tuple[int, int], np.ndarray] = {}
        give_back()

    def lead(self, text: tuple) -> tuple[int, int]:
        """The frequent term that weighs most in a text, and its model."""
        row = self.index.row[text[0]]
        often = row >= 0
        w = (1.0 + np.log(text[1][often])) * self.idf[text[0][often]]
        return (int(row[often][w.argmax()]) if len(w) else -1), text[-1]

    def facts(self, texts: list[tuple[np.ndarray, np.ndarray, int, int]], without: list[int] | None = None, opened: tuple | None = None) -> list[tuple[np.ndarray, float, int]]:
        """For texts (terms, counts, other words, model): the nearest examples, the feature (log odds of the vote and of the marks) and the amount of
        evidence: 0 without a mark, 1 for one occurrence of one, which may be chance, 2 for more, 3 for examples with the very vector,
        which alone vote. ``without`` names a further fold that must not be found."""
        keys = [(model, model if without is None else without[k]) for k, (_, _, _, model) in enumerate(texts)]
        for key in set(keys) - self.masks.keys():
            self.masks[key] = self.index.barred(self.fold, *key)
        opened = opened or self.index.opened([t[:2] for t in texts])
        found = self.index.nearest(opened, self.k, np.stack([self.masks[key] for key in keys]))
        return [self._judged(*text, *near) for text, near in zip(texts, found, strict=True)]

    def _judged(self, terms, counts, other, model, near, cos) -> tuple[np.ndarray, float, int]:
        weight = self.class_weight[model][self.y[near]]
        same = cos >= 1.0 - 1e-9
        if same.any() and not other:
            return near, log_odds(vote(cos[same], self.y[near[same]], (weight * self.n[near])[same]), 0.001), 3
        at, odds = self.marks[model]
        place = np.minimum(np.searchsorted(at, terms), max(0, len(at) - 1))
        ours = at[place] == terms if len(at) else np.zeros(len(terms), bool)
        return near, log_odds(vote(cos, self.y[near], weight)) + float(odds[place[ours]].sum()), int(min(2, counts[ours].sum()))


def chunks(texts: list[tuple], lead, size: int = CHUNK) -> Iterator[list[int]]:
    """Numbers of the texts in lists of ``size``, alike ones (by ``lead`` of their terms) next to each other."""
    order = sorted(range(len(texts)), key=lambda i: lead(texts[i]))
    yield from (order[k:k + size] for k in range(0, len(order), size))


def fitted(rows: list[tuple[int, float, float, int]], amount: int) -> tuple[np.ndarray, np.ndarray]:
    """Monotone fit over the judged examples (y, weight, feature, amount) with this amount of evidence, or over all of them where these are
    few, or copies of one class."""
    own = [r for r in rows if r[3] == amount]
    if len(own) < LEAST_ROWS or amount == 3 and len({r[0] for r in own}) < 2:
        own = rows
    prior = sum(r[0] * r[1] for r in own) / sum(r[1] for r in own)
    return monotone([r[2] for r in own], [r[0] for r in own], [r[1] for r in own], prior)


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = EXAMPLES, n_marks: int = MARKS, k: int = K, postings: int = POSTINGS) -> DataFrame:
    """doc_id, held_out, score, predicted, nearest (ids of the three nearest examples), evidence (the text's marks), row_key."""
    sc = docs.sparkSession.sparkContext
    sample, sizes = sampled(staged(training_texts(docs, labels)), per_class)
    examples = staged(spelled(docs, sample, postings))
    told = examples.select("key", "fold", "y", "n", "doc_id", "terms", "counts").toArrow().sort_by([("key", "ascending"), ("y", "ascending")])
    key, fold, y, n = (told.column(c).to_numpy().astype(np.int64) for c in ("key", "fold", "y", "n"))
    texts = np.zeros((FOLDS, 2))
    np.add.at(texts, (fold, y), 1)
    flat, counts = (told.column(c).combine_chunks().flatten().to_numpy() for c in ("terms", "counts"))
    lengths = told.column("terms").combine_chunks().value_lengths().to_numpy().astype(np.int64)
    vocab = np.unique(flat)
    vecs = staged_by_few(vectors(docs, vocab))
    n_docs = vecs.count()
    df = vecs.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toArrow()
    idf = np.full(len(vocab), np.log(1.0 + n_docs) + 1.0)
    idf[df.column("t").to_numpy().astype(np.int64)] = np.log((1.0 + n_docs) / (1.0 + df.column("n").to_numpy())) + 1.0

    numbers = np.searchsorted(vocab, flat).astype(np.int32)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    order = np.lexsort((numbers, owner))
    picks = marked_terms(examples, texts, n_marks)
    names = names_of(examples, set().union(*picks.values()))
    marks, prior, class_weight = [], [], []
    for m in models_of():
        own = inside(m, range(FOLDS))
        at = np.array(sorted(picks[m]), dtype=np.int64)
        marks.append((np.searchsorted(vocab, at), np.array([picks[m][t] for t in at.tolist()])))
        size, got = sizes[own].sum(axis=0), texts[own].sum(axis=0)
        class_weight.append(np.divide(size, got, out=np.zeros(2), where=got > 0))
        prior.append(float((size[1] + 0.5) / (size.sum() + 1.0)) if size.sum() else 0.5)
    plain = {"terms": numbers[order], "counts": counts[order].astype(np.int32), "sizes": lengths, "key": key, "fold": fold, "y": y, "n": n, "idf": idf, "k": k, "marks": marks, "class_weight": class_weight}
    ids = [str(x) for x in told.column("doc_id").to_pylist()]
    sent = sc.broadcast(plain)
    del told, flat, counts, numbers, owner, order, plain  # the driver waits for the judging with little more than the broadcast
    give_back()

    @released
    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, out = Judge(sent.value), []
        cuts = np.concatenate([[0], np.cumsum(judge.sizes)])
        for batch in batches:
            nos = [i for i in batch.column("id").to_pylist() if judge.sizes[i]]
            texts = [(judge.terms[cuts[i]:cuts[i + 1]], judge.counts[cuts[i]:cuts[i + 1]], 0, FOLDS) for i in nos]
            for part in chunks(texts, judge.lead):
                own = [int(judge.fold[nos[j]]) for j in part]
                opened = judge.index.opened([texts[j][:2] for j in part])
                for m in models_of():
                    facts = judge.facts([(*texts[j][:3], m) for j in part], own, opened)
                    out += [(m, nos[j], *f[1:]) for j, g, f in zip(part, own, facts, strict=True) if m != g]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.float64(), pa.int32()))], ["model", "no", "x", "amount"])

    parts = max(1, -(-len(key) // 500))
    judged = docs.sparkSession.range(0, len(key), 1, parts).mapInArrow(left_out, "model int, no long, x double, amount int").toArrow().to_pydict()
    fits, blank = [], []
    for m in models_of():
        rows = [(int(y[i]), float(class_weight[m][y[i]]), x, a) for mm, i, x, a in zip(*judged.values(), strict=True) if mm == m]
        both = len({r[0] for r in rows}) == 2
        fits.append([fitted(rows, a) for a in range(4)] if both else None)
        empty = [class_weight[m][y[i]] * np.array([1.0, y[i]]) for i in range(len(key)) if not lengths[i] and fold[i] != m]
        blank.append(float((sum(e[1] for e in empty) + prior[m]) / (sum(e[0] for e in empty) + 1.0)) if both else prior[m])

    @released
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, memo, vocab_of = Judge(sent.value), {}, words.value

        def told(text: tuple, near: np.ndarray, x: float, amount: int) -> tuple:
            model, s = text[3], blank[text[3]]
            if len(near) and fits[model]:
                ends, values = fits[model][amount]
                s = float(values[max(int(np.searchsorted(ends, x, side="right")) - 1, 0)])
            own = np.isin(text[0], judge.marks[model][0])
            return s, ",".join(ids[i] for i in near[:3]), ",".join(sorted(names.get(int(vocab_of[j]), "") for j in text[0][own]))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("held_out", "fold", "other")]
            lists = [[x.values.to_numpy() for x in batch.column(c)] for c in ("terms", "counts")]
            rows = [(t, c, other, FOLDS if held else own_fold) for held, own_fold, other, t, c in zip(*columns, *lists, strict=True)]
            keys = [hashlib.blake2b(t.tobytes() + c.tobytes() + bytes([model, other > 0]), digest_size=16).digest() for t, c, other, model in rows]
            if len(memo) > 50_000:
                memo.clear()
            new = list({key: row for key, row in zip(keys, rows, strict=True) if key not in memo}.items())
            empty = [x for x in new if not len(x[1][0])]
            memo |= {key: told(row, np.empty(0, np.int64), 0.0, 0) for key, row in empty}
            new = [x for x in new if len(x[1][0])]
            texts = [row for _, row in new]
            for part in chunks(texts, judge.lead):
                for j, facts in zip(part, judge.facts([texts[j] for j in part]), strict=True):
                    memo[new[j][0]] = told(texts[j], *facts)
            out = list(zip(*(memo[key] for key in keys), strict=True)) or [[], [], []]
            predicted = pa.array([int(s >= THRESHOLD) for s in out[0]], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(out[0], pa.float64()), predicted, pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), batch.column("row_key")],
                ["doc_id", "held_out", "score", "predicted", "nearest", "evidence", "row_key"])

    words = sc.broadcast(vocab)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return staged_by_few(vecs.mapInArrow(rate, f"doc_id {kind}, held_out boolean, score double, predicted int, nearest string, evidence string, row_key long"))


def op10_nearest_examples(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("row_key")
