"""Nearest neighbours against brute force, toxicity on planted terms and held-out rows."""

import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
from callstrata.llm.op09_hnsw import neighbours, op9_hnsw_shards
from callstrata.llm import op10_toxicity as op10
from callstrata.llm.op10_toxicity import Index, monotone, op10_nearest_examples, score_toxicity, weighed
from conftest import SF
from pyspark.sql import functions as F


def recall(got, want):
    hit = sum(len({i for i, _ in want[q]} & {r["vec_id"] for r in got if r["query_id"] == q}) for q in want)
    return hit / max(1, sum(len(v) for v in want.values()))


def test_neighbours_are_found_on_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    queries = {i for i, _ in rows if i % 20 == 0}
    got = op9_hnsw_shards(spark, SF).collect()
    want = brute.nearest(rows, queries)
    assert recall(got, want) >= 0.95
    vec = dict(rows)
    for q in queries:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and q not in {r["vec_id"] for r in mine}
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        for r in mine:
            assert abs(r["score"] - float(np.dot(np.float64(vec[q]), np.float64(vec[r["vec_id"]])))) < 1e-9


def test_neighbours_with_odd_vectors_and_shards(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(k, [float(x) for x in centres[k % 12] + 0.3 * rng.normal(size=16)]) for k in range(700)]
    rows += [(1000 + k, rows[3][1]) for k in range(90)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] + [0.0] * 14), (2080, [1.0] * 5), (None, rows[5][1]), (2100, [float("inf")] + [0.0] * 15), (40, rows[40][1])]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], "vec_id long, embedding array<double>, node string, vec string")
    got = neighbours(df, df.filter("vec_id % 20 = 0"), shard_rows=200).collect()
    good = [(i, v) for i, v in rows if v is None or len(v) == 16]
    want = brute.nearest(good, {i for i, _ in good if i is not None and i % 20 == 0})
    assert {r["query_id"] for r in got} == set(want)
    assert recall(got, want) >= 0.97
    for q in (1000, 1020):
        same = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert same == [i for i, _ in want[q]]


def test_neighbours_of_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], kind)
    got = neighbours(df, df.filter("vec_id = 0")).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 0.5), (2, 2, -1.0)]
    assert neighbours(spark.createDataFrame([], kind), spark.createDataFrame([], kind)).count() == 0


def planted(seed=1, n=900):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        toxic = k % 3 == 0
        w = [f"w{rng.randrange(300)}" for _ in range(rng.choice([5, 40, 120]))]
        if toxic:
            for t in rng.sample(["vile", "filth", "loathe", "rotten"], 2):
                w.insert(rng.randrange(len(w)), t.upper() if k % 2 else t)
        docs.append((k, " ".join(w), "s"))
        labels.append((k, 0, int(toxic)))
    docs += [(5000, None, None), (5001, "", "s"), (5002, " ".join(["w1"] * 40_000) + " vile filth", "s"), (5001, "", "s"), (None, "vile filth rotten", "s")]
    labels += [(5000, None, 1), (9999, None, 1), (None, 0, 1), (3, 0, None), (4, 0, 7)]
    return docs, labels


def test_toxicity_finds_planted_terms(spark):
    docs, labels = planted()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = score_toxicity(brute.documents(spark, docs), lab).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["doc_id"] is None or r["doc_id"] < 900 or r["doc_id"] == 5002:
            assert r["predicted"] == int(r["doc_id"] is None or r["doc_id"] % 3 == 0 or r["doc_id"] == 5002)
    assert {r["predicted"] for r in got if r["doc_id"] in (5000, 5001)} == {0}


def test_toxicity_knows_copies_of_labelled_texts_without_marks(spark):
    docs, labels = planted()
    train = [i for i in range(6000, 6200) if zlib.crc32(str(i).encode()) % 3 != 1][:6]
    held = [i for i in range(7000, 7200) if zlib.crc32(str(i).encode()) % 3 == 1][:6]
    for k, (a, b) in enumerate(zip(train, held)):
        text = f"only{k} this{k} slur{k // 2} " + " ".join(f"w{j}" for j in range(k // 2, 30))
        docs += [(a, text, "s"), (b, text.upper(), "s")]
        labels.append((a, 0, int(k < 4)))
    got = {r["doc_id"]: r for r in score_toxicity(brute.documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for k, (a, b) in enumerate(zip(train, held)):
        assert got[b]["nearest"].split(",")[0] == str(a) and got[b]["evidence"] == "" and got[b]["predicted"] == int(k < 4)


def test_toxicity_learns_only_from_training_rows(spark):
    docs, labels = planted()
    flip = [(i, q, 1 - t if t in (0, 1) and i is not None and zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    kind = "doc_id long, quality int, toxic int"
    df = brute.documents(spark, docs)
    a, b = (sorted((str(r["doc_id"]), r["score"]) for r in score_toxicity(df, spark.createDataFrame(x, kind)).collect()) for x in (labels, flip))
    assert a == b


def test_toxicity_without_labels_or_documents(spark):
    kind = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], kind)
    assert score_toxicity(brute.documents(spark, []), none).count() == 0
    docs = brute.documents(spark, [(1, "a b", "s"), (2, None, None)])
    assert {r["score"] for r in score_toxicity(docs, none).collect()} == {0.5}
    assert score_toxicity(docs, spark.createDataFrame([(1, 0, 1), (2, 0, 1), (3, 0, 1)], kind)).filter("score < 0.5").count() == 0


def test_no_label_decides_its_own_row(spark):
    """Another label for one training row, or for all copies of its text, leaves its own score as it was."""
    docs, labels = planted()
    train = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1]
    copies = [i for i in range(9000, 9100) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
    docs += [(i, docs[train[0]][1], "s") for i in copies]
    labels += [(i, 0, 1) for i in copies]
    kind = "doc_id long, quality int, toxic int"
    df = brute.documents(spark, docs)

    def scores(rows):
        return {r["doc_id"]: r["score"] for r in score_toxicity(df, spark.createDataFrame(rows, kind)).collect()}

    first = scores(labels)
    for flipped in ({train[1]}, {train[2]}, {train[0], *copies}):
        again = scores([(i, q, 1 - t if i in flipped and t in (0, 1) else t) for i, q, t in labels])
        assert all(again[i] == first[i] for i in flipped) and again != first


def test_a_bound_on_the_terms_keeps_whole_texts(spark):
    docs, labels = planted()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sample, sizes = op10.sampled(op10.training_texts(brute.documents(spark, docs), lab), (120, 80))
    assert sizes.sum() > 400 and sample.count() <= 200
    kept = op10.spelled(brute.documents(spark, docs), sample, 4000).collect()
    by_text = {t: i for i, t, _ in docs}
    for f in range(op10.FOLDS):
        for y in (0, 1):
            own = [r for r in kept if (r["fold"], r["y"]) == (f, y)]
            assert own and (len(own) == 1 or sum(len(r["terms"]) for r in own) <= 4000 // (2 * op10.FOLDS))
    assert all(len(r["terms"]) == len(set(brute.words(r["text"]))) and r["text"] in by_text for r in kept)


def test_index_gives_the_exact_nearest_examples():
    rng = np.random.default_rng(3)
    n, size = 700, 400
    idf = rng.random(size) + 0.5
    share = 1 / np.arange(1, size // 2 + 1)
    terms = [np.sort(rng.choice(size // 2, size=rng.integers(1, 25), replace=False, p=share / share.sum())) + k % 2 * size // 2 for k in range(n)]
    counts = [rng.integers(1, 4, len(t)) for t in terms]
    terms[5], counts[5] = terms[4], counts[4]
    terms[9], counts[9] = np.empty(0, int), np.empty(0, int)
    order = rng.permutation(n)
    index = Index(terms, counts, idf, order)
    assert 0 < len(index.dense) < size and len(index.nos)
    dense = np.zeros((n, size))
    for k, (t, c) in enumerate(zip(terms, counts)):
        if len(t):
            dense[k, t] = weighed(c.astype(float), idf[t])
    own = [k for k in range(0, n, 7) if len(terms[k])]
    own.sort(key=lambda k: int(terms[k][0]))
    for lo in range(0, len(own), 8):
        part = own[lo:lo + 8]
        barred = rng.random((len(part), n)) < 0.3
        masks = np.ones((len(part), index.width), bool)
        masks[:, :n] = barred[:, index.old]
        opened = index.opened([(terms[k], counts[k]) for k in part])
        for row, k, (near, cos) in zip(range(len(part)), part, index.nearest(opened, 10, masks), strict=True):
            real = dense @ dense[k]
            assert ((opened[0][row] + np.repeat(opened[2][row], op10.BLOCK))[:n] + 1e-9 >= real[index.old]).all()
            truth = np.round(real, 12)
            truth[barred[row]] = -1
            want = np.lexsort((order, -truth))[:10]
            want = want[truth[want] > 0]
            assert np.allclose(cos, truth[want]) and near.tolist() == want.tolist()
    assert 0 < index.opened_blocks < index.all_blocks
    few = Index(terms[:3], counts[:3], idf, order[:3])
    near, _ = few.nearest(few.opened([(terms[0], counts[0])]), 10, few.barred(np.array([0, 1, 0]), 1)[None])[0]
    assert near[0] == 0 and 1 not in near


def test_neighbours_of_texts_match_plain_cosines(spark):
    """Every document of the table: its three nearest examples, by dictionaries, without its fold unless it is held out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text", op10.text_key(F.col("text")).alias("key")).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows}
    bags = {r["key"]: Counter(brute.words(r["text"])) for r in rows}
    examples = {}
    for r in rows:
        if not held[r["doc_id"]] and labels.get(r["doc_id"]) in (0, 1):
            key = (r["key"], labels[r["doc_id"]])
            examples[key] = min(examples.get(key, r["doc_id"]), r["doc_id"])
    vocab = {t for key, _ in examples for t in bags[key]}
    df = Counter(t for r in rows for t in bags[r["key"]] if t in vocab)
    vec = {}
    for key, bag in bags.items():
        w = {t: (1 + math.log(c)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, c in bag.items() if t in vocab}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        vec[key] = {t: x / norm for t, x in w.items()}
    got = {r["doc_id"]: r for r in op10_nearest_examples(spark, SF).collect()}
    fold = {key: key % op10.FOLDS for key in bags}
    for r in rows:
        cos = sorted(((-round(sum(x * vec[k].get(t, 0.0) for t, x in vec[r["key"]].items()), 9), k, y, i) for (k, y), i in examples.items() if held[r["doc_id"]] or fold[k] != fold[r["key"]]))
        want = [c for c in cos if c[0] < 0][:3]
        mine = [int(x) for x in got[r["doc_id"]]["nearest"].split(",") if x]
        near = {i: c for c, _, _, i in cos}
        assert len(mine) == len(want) and all(abs(near[a] - w[0]) < 1e-8 for a, w in zip(mine, want)), r["doc_id"]


def test_monotone_fit_pools_violators():
    ends, values = monotone([0.1, 0.2, 0.3, 0.4], [0, 1, 0, 1], [1.0] * 4, 0.5)
    assert ends.tolist() == [0.1, 0.2, 0.4] and (np.diff(values) > 0).all()


def test_toxicity_on_the_table(spark):
    """Held-out rows and training rows alike, as none is judged with its own label."""
    larger = "/root/testdata/sf0.01"
    got = op10_nearest_examples(spark, larger).cache()
    assert got.count() == spark.read.parquet(f"{larger}/documents.parquet").count()
    known = got.join(spark.read.parquet(f"{larger}/labels.parquet").filter("toxic IS NOT NULL"), "doc_id")
    rates = {(r["held_out"], r["toxic"]): r["p"] for r in known.groupBy("held_out", "toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert rates[True, 0] < 0.03 and rates[False, 0] < 0.03 and rates[True, 1] > 0.7 and rates[False, 1] > 0.5
    assert got.select("score").distinct().count() > 2
