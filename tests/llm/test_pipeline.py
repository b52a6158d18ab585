"""The pipeline, stage by stage, against plain Python and the operators' own tests."""

import ctypes
import gc
import multiprocessing
import random
import re
from pathlib import Path

import brute
import corpus_pipeline as pipe
import numpy as np
import pyarrow as pa
from conftest import SF
from pyspark.sql import types as T

from callstrata.llm import op10_toxicity as op10
from callstrata.llm.op06_lsh_forest import signed
from callstrata.llm.text import BATCH, staged_by_few

LARGER = "/root/testdata/sf0.01"  # the smallest table with enough toxic labels to learn from


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    data = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = docs
    by_name = dict(pipe.STAGES)
    assert list(by_name) == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    kept = pipe.staged(by_name["toxicity"](spark, docs, LARGER))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    left = sorted(ids(kept))
    pairs = brute.links([data[i] for i in left])
    root = brute.classes(len(left), pairs)
    kept = pipe.staged(by_name["near_duplicates"](spark, kept, LARGER))
    assert kept.columns == docs.columns and ids(kept) == [left[i] for i in range(len(left)) if root[i] == i]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()]
    grams = {tuple(v[k:k + 10]) for _, t in bench for v in [brute.words(t)] for k in range(len(v) - 9)}
    clean = [i for i in ids(kept) if not any(tuple(w[p:p + 10]) in grams for w in [brute.words(data[i])] for p in range(len(w) - 9))]
    kept = pipe.staged(by_name["decontamination"](spark, kept, LARGER))
    assert kept.columns == docs.columns and ids(kept) == clean
    clean = [i for i in ids(kept) if not brute.secrets(data[i])[4]]
    kept = pipe.staged(by_name["secrets"](spark, kept, LARGER))
    assert kept.columns == docs.columns and set(clean) <= set(ids(kept)) <= {*ids(kept)}
    mixed = by_name["mixing"](spark, kept, LARGER)
    assert ids(mixed) == ids(kept)
    assert sorted(map(str, pipe.run(spark, LARGER).collect())) == sorted(map(str, mixed.collect()))


def test_near_duplicates_keep_one_of_each_group(spark):
    rng = random.Random(8)
    a, b = (" ".join(f"w{rng.randrange(500)}" for _ in range(80)) for _ in range(2))
    rows = [(3, a, "x"), (1, a + " tail", "x"), (2, a, "y"), (2, a, "y"), (9, b, None), (9, b, None), (None, "null id " + b[:30], "z"), (None, None, "z"), (5, "", "z"), (6, None, "z"), (None, a, "q")]
    got = pipe.near_duplicate_stage(spark, brute.documents(spark, rows), SF)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect()) == sorted(
        [("1", a + " tail"), ("9", b), ("None", "null id " + b[:30]), ("None", ""), ("5", ""), ("6", "")])
    assert got.columns == brute.documents(spark, rows).columns


def test_empty_documents_pass_through(spark):
    docs = brute.documents(spark, [])
    for _, stage in pipe.STAGES:
        assert stage(spark, docs, SF).count() == 0


class Kept:
    """Stands for a table and keeps the Arrow task."""

    schema = {"doc_id": T.StructField("doc_id", T.LongType())}

    def select(self, *_):
        return self

    def mapInArrow(self, task, _):
        self.task = task
        return self


def grown(task, batches, told):
    mb = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    for _ in batches():  # what the making of the rows takes is there before
        pass
    gc.collect()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    before = mb()
    for _ in task(batches()):
        pass
    told.put(mb() - before)


def test_an_idle_worker_keeps_no_memory(spark):
    def batches():
        rng = random.Random(4)
        for k in range(2):
            texts = [" ".join(f"w{x}" for x in rng.choices(range(20_000), k=500)) for _ in range(6000)]
            yield pa.RecordBatch.from_pydict({"doc_id": range(6000), "row_key": range(6000), "text": texts})

    task = signed(Kept(), 20, 5, 4).task
    own = multiprocessing.get_context("fork")
    told = own.Queue()
    child = own.Process(target=grown, args=(task, batches, told))
    child.start()
    mb = told.get(timeout=120)
    child.join()
    assert mb < 40, mb


def judged(batches):
    """Every batch is what a judge is made of; it searches some of its own examples."""
    for plain in batches:
        judge, ends = op10.Judge(plain), np.cumsum([0, *plain["sizes"]])
        own = [(plain["terms"][a:b], plain["counts"][a:b], 1, k % 5) for k, (a, b) in enumerate(zip(ends[:256], ends[1:257]))]
        for part in op10.chunks(own, judge.lead):
            judge.facts([own[k] for k in part])
        yield judge  # still there when the memory is measured


def held(task, batches, told):
    mb = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    plain = list(batches())
    before, kept = mb(), []
    for x in task(plain):
        kept.append(x)
    told.put(mb() - before)


def test_an_index_takes_little_memory():
    """4400 examples of 300 terms; two workers of an executor hold an index each."""
    def batches():
        rng, n, size = np.random.default_rng(4), 4400, 200_000
        share = 1 / np.arange(1, size + 1)
        ends = np.cumsum(share / share.sum())
        terms = [np.unique(np.searchsorted(ends, rng.random(600)).clip(max=size - 1)).astype(np.int32) for _ in range(n)]
        flat = np.concatenate(terms)
        assert len(flat) > 1_200_000
        yield {"terms": flat, "counts": np.ones(len(flat), np.int32), "sizes": np.array([len(t) for t in terms]), "key": np.arange(n), "fold": np.arange(n) % 4, "y": np.arange(n) % 2, "n": np.ones(n, int),
               "idf": np.ones(size), "k": 25, "marks": [(np.empty(0, int), np.empty(0))] * 5, "class_weight": [np.ones(2)] * 5}

    own = multiprocessing.get_context("fork")
    told = own.Queue()
    child = own.Process(target=held, args=(judged, batches, told))
    child.start()
    mb = told.get(timeout=120)
    child.join()
    assert mb < 70, mb


def test_whole_texts_go_to_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int64())})

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(0, 9000, 1, 1)
    assert max(r["n"] for r in rows.mapInArrow(sizes, "n long").collect()) > BATCH
    found = [r["n"] for r in staged_by_few(rows.mapInArrow(sizes, "n long")).collect()]
    assert sum(found) == 9000 and max(found) <= BATCH
    assert spark.conf.get(name) == before
