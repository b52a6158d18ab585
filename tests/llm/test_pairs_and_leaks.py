"""Similarity join, decontamination and mixing against plain Python."""

import random

import brute
import pytest
from callstrata.llm import op06_lsh_forest as lsh
from callstrata.llm.op05_mixing import mix, op5_source_mix, schedule
from callstrata.llm.op06_lsh_forest import op6_lsh_forest, similarity_join
from callstrata.llm.op08_decontam import decontaminate, op8_positional_index
from conftest import SF


def text_of(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def near(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    rng = random.Random(seed)
    rows = [(None, "null id " + text_of(rng, 30), None), (1, None, "a"), (2, "", "a"), (3, "one two", "a"), (4, "ONE, two!", "b"), (5, "one two three", "b")]
    for k in range(25):
        base = text_of(rng, rng.choice([8, 40, 150, 400]))
        rows.append((100 + 20 * k, base, "a"))
        rows += [(100 + 20 * k + j, near(rng, base, rng.choice([0, 1, 2, 4, 8])), "b") for j in range(1, rng.choice([2, 4, 7]))]
    hub = text_of(rng, 300)
    rows += [(5000 + k, near(rng, hub, 3), "c") for k in range(40)]
    rows.append(rows[-1])
    rows.append((6000, text_of(rng, 25_000, 5000), "c"))
    return rows


@pytest.mark.parametrize("rows", [512, 7])
def test_similarity_join_loses_no_link(spark, rows):
    data = corpus(3)
    pairs = brute.links([t for _, t, _ in data])
    root = brute.classes(len(data), pairs)
    n = [sum(k in p for p in pairs) for k in range(len(data))]
    named = [min((data[j][0] for j in range(len(data)) if root[j] == root[i] and data[j][0] is not None), default=None) for i in range(len(data))]
    named = [data[i][0] if not brute.shingle_set(data[i][1]) else named[i] for i in range(len(data))]
    got = similarity_join(brute.documents(spark, data), rows=rows).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in got) == sorted((str(d[0]), str(c), k) for d, c, k in zip(data, named, n))


def test_similarity_join_shortens_the_prefix():
    assert lsh.shallowest(20, 5, 0.8, 0.9) == 5 and lsh.shallowest(20, 5, 0.8, 0.9999) == 4
    assert lsh.found_odds(0.8, 20, 4) > 0.9999 > lsh.found_odds(0.8, 20, 5)


def test_a_large_group_does_not_shorten_the_search_of_others(spark):
    rng = random.Random(6)
    hub = text_of(rng, 400, 10**6)
    data = [(k, near(rng, hub, 1), "a") for k in range(120)]
    for k in range(60):
        w = text_of(rng, 104, 10**6).split()
        v = w[:94] + text_of(rng, 10, 10**6).split()  # 90 of 110 shingles are shared
        data += [(1000 + 2 * k, " ".join(w), "b"), (1001 + 2 * k, " ".join(v), "b")]
    got = similarity_join(brute.documents(spark, data), trees=4, recall=0.9).filter("doc_id >= 1000 AND n_links = 1").count() / 120
    assert lsh.found_odds(90 / 110, 4, 5) < 0.84 and got >= 0.9


def test_similarity_join_on_the_table_and_on_nothing(spark):
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    pairs = brute.links([t for _, t in data])
    root = brute.classes(len(data), pairs)
    want = [(data[i][0], data[root[i]][0], sum(i in p for p in pairs)) for i in range(len(data))]
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in op6_lsh_forest(spark, SF).collect()) == want
    assert similarity_join(brute.documents(spark, [])).count() == 0


ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
BENCH = [(1, ITEM), (2, "Rare short one"), (3, None), (4, "..."), (10, ITEM + " nu xi"), (2, "Rare short one"), (None, "null item with quite a few words in it here now"), (5, "single")]


def leaks():
    rng = random.Random(5)
    fill = text_of(rng, 60)
    return [
        (1, fill + " " + ITEM.upper() + ". " + fill, "a"), (2, ITEM, "a"), (3, " ".join(ITEM.split()[:9]), "b"), (4, " ".join(ITEM.split()[1:11]), "b"), (5, None, None), (6, "", "b"),
        (7, "rare, SHORT: one! rare short one rare short", "b"), (8, (ITEM + " ") * 300, "c"), (8, (ITEM + " ") * 300, "c"), (9, "Álpha beta gamma delta epsilon zeta eta theta iota kappa", "c"),
        (None, "x null item with quite a few words in it here now y", "c"), (10, "rare z short one", "c"), (11, "single singles single", None), (12, "alpha alpha " + ITEM + " alpha beta", "d"),
        (13, text_of(rng, 20_000) + " " + ITEM + " " + text_of(rng, 20_000), "d")]


def test_decontamination_matches_plain_search(spark):
    data = leaks()
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in BENCH], "item_id long, text string, words string, item string")
    got = decontaminate(brute.documents(spark, data), bench).collect()
    want = []
    for i, t, _ in data:
        n, hit, _ = brute.hits(t, BENCH)
        items = brute.hits(t, [b for b in BENCH if b[0] is not None])[2]
        want.append((str(i), n, hit, len(items), brute.digest(",".join(items)), hit > 0))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == sorted(want)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[10]["n_near"] == 1 and by_id[7]["n_near"] == 0


def test_decontamination_on_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontaminate(brute.documents(spark, []), one).count() == 0
    r = decontaminate(brute.documents(spark, [(1, ITEM, "a")]), none).first()
    assert (r["n_words"], r["n_hit"], r["contaminated"]) == (12, 0, False)


def test_decontamination_on_the_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {}
    for i, t in bench:
        v = brute.words(t)
        for k in range(len(v) - 9):
            grams.setdefault(tuple(v[k:k + 10]), set()).add(str(i))
    for r in op8_positional_index(spark, SF).collect():
        w = brute.words(docs[r["doc_id"]])
        hit = {q for p in range(len(w) - 9) if tuple(w[p:p + 10]) in grams for q in range(p, p + 10)}
        assert (r["n_words"], r["n_hit"]) == (len(w), len(hit))


def test_mix_reaches_its_targets(spark):
    rng = random.Random(9)
    data = [(k, text_of(rng, rng.choice([0, 1, 5, 60, 900])), rng.choice(["b", "a", None, "é", "a", "a", "Z", "😀"])) for k in range(300)]
    data += [(1000, None, "a"), (None, "null id", "a"), (1001, "  \t\n ", "z"), (7, data[7][1], data[7][2]), (1002, text_of(rng, 40_000), "a"), (1003, "a\x0bb\x1fc d", "b")]
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute.targets(sizes)
    docs = brute.documents(spark, data)
    for block in (64, 4096):
        got = mix(docs, block=block).collect()
        assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), size(t)) for i, t, _ in data)
        taken = {}
        for r in got:
            assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
            assert r["target"] == pytest.approx(want[r["source"]])
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        for s, t in want.items():
            assert abs(taken[s] - t) <= 0.5 + 1e-6
        assert sorted(map(str, got)) == sorted(map(str, mix(docs, block=block).collect()))


def test_mix_is_even_along_the_schedule(spark):
    rng = random.Random(2)
    data = [(k, text_of(rng, 50), "abc"[k % 3]) for k in range(1500)]
    laid, mixed = schedule(brute.documents(spark, data), block=50)
    rows = mixed.select("slot", "skey", "n_words").collect()
    total = {}
    for r in rows:
        total[r["skey"]] = total.get(r["skey"], 0) + r["n_words"]
    last, whole = max(r["slot"] for r in rows) + 1, sum(total.values())
    for part in (4, 8):
        head = [r for r in rows if r["slot"] < last / part]
        n = sum(r["n_words"] for r in head)
        for s, t in total.items():
            assert abs(sum(r["n_words"] for r in head if r["skey"] == s) / n - t / whole) < 0.03


def test_mix_on_the_table_and_on_nothing(spark):
    rows = op5_source_mix(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert mix(brute.documents(spark, [])).count() == 0
    r = mix(brute.documents(spark, [(1, None, None)])).first()
    assert (r["size"], r["target"], r["taken"]) == (0, 0.0, 0)
