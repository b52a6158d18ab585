"""Spelling variants, whitening and exact copies against plain Python, with every odd case."""

import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from callstrata.llm import op11_spelling, op12_whitening, op13_exact_dedup
from callstrata.llm.op11_spelling import Filters, op11_bloom_variants, variants
from callstrata.llm.op12_whitening import op12_block_whitening, whiten
from callstrata.llm.op13_exact_dedup import exact_groups, filter_words, op13_bloom_dedup, repeated_bits, without_copies
from conftest import SF

# --- spelling variants -------------------------------------------------------------------------


def brute_variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in words:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for own in holes.values():
        for w in own:
            near[w] |= own - {w}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}

    def last(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), last(w), c, len(near[w]), words[form[w]] if w in form else 0) for w, c in words.items())


def told(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def spelled():
    rng = random.Random(3)
    base = ["letter", "lettér", "lettter", "etter" * 4, "Straßen", "naïvely", "z" * 300, "ÀÉÎõü÷×", "aaaaaa", "banana", "abcdefghij" * 9, "ÿyÿyÿy"]
    rows = []
    for k in range(400):
        words = []
        for _ in range(12):
            w = rng.choice(base)
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                i = rng.choice((0, 3))
                w = rng.choice((w[:i] + w[i + 1:], w[:i] + rng.choice("aeÀÿ") + w[i:], w[:i] + rng.choice("bzÉ") + w[i + 1:]))
            words.append(w)
        rows.append((k if k % 50 else None, rng.choice((" ", ", ", "-", "1", "Ā")).join(words), "s"))
    rows += [(1000, None, "s"), (1001, "", "s"), (1001, "", "s"), (1002, "x" * 5_000, None), (1002, "x" * 5_000, None), (1003, "123 ... 😀", "s")]
    rows += [(2000 + k, "x" * 5_000, "s") for k in range(4)] + [(k, "occurs " * 3000 + "occurss " * 5 + ("occurssz" if k % 2 else "occurz"), "hot") for k in range(3000, 3020)]
    return rows


def test_variants_match_plain_search(spark):
    rows = spelled()
    want = brute_variants([(i, t) for i, t, _ in rows])
    assert told(variants(brute.documents(spark, rows))) == want
    assert sum(w[4] for w in want) > 50 and any(w[1] and w[2] != w[1] for w in want)


def test_full_filters_only_let_more_through(spark):
    rows = spelled()
    assert told(variants(brute.documents(spark, rows), filters_words=64)) == brute_variants([(i, t) for i, t, _ in rows])


def test_filters_are_bounded_and_hold_their_words():
    f = Filters({6: 10**9, 7: 3, 70: 10**6}, 1 << 16)
    assert f.total <= 1 << 16 and all(int(f.size[s]) & (int(f.size[s]) - 1) == 0 for s in (6, 7, 70))
    f = Filters({8: 1000})
    f.blocks = np.zeros(f.total, np.int64)
    h = np.random.default_rng(1).integers(0, 2**63, 21_000).astype(np.uint64)
    block, mask = f.at(h[:1000], 8)
    np.bitwise_or.at(f.blocks, block, mask)
    assert f.holds(h[:1000], 8).all() and f.holds(h[1000:], 8).mean() < 0.02
    assert not f.holds(h, 9).any()


def test_paths_of_forms_are_followed_to_the_end(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(13)] + [("v", "w5")], "word string, form string")
    assert {r["word"]: r["root"] for r in op11_spelling.roots(forms).collect()} == {**{f"w{k}": "w13" for k in range(13)}, "v": "w13"}


def test_variants_on_the_table_and_on_nothing(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert told(op11_bloom_variants(spark, SF)) == brute_variants(rows)
    assert variants(brute.documents(spark, [])).count() == 0
    assert variants(brute.documents(spark, [(1, "a short text", "s"), (2, None, None)])).columns == ["word", "form", "root", "n", "n_near", "form_n"]


# --- whitening ---------------------------------------------------------------------------------

VECS = "vec_id long, embedding array<float>, i long, x string, index int, vector string, c double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "v", 0.5) for i, v in rows], VECS)


def check_whitened(got, rows, components):
    """rows: the (vec_id, vector) that take part."""
    x = np.floor(1024 * np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)) + 100_000
    n, s = len(x), [int(t) for t in x.sum(axis=0)]
    deviation = Counter((i, sum((n * int(a) - b) ** 2 for a, b in zip(row, s))) for (i, _), row in zip(rows, x))
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == deviation
    c = x - x.mean(axis=0)
    value, vector = np.linalg.eigh(c.T @ c / n)
    value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
    by_row = defaultdict(dict)
    for r in got:
        by_row[r["vec_id"], r["deviation"]].setdefault(r["component"], []).append(r["whitened"])
        assert abs(r["explained"] - value[r["component"] - 1] / np.trace(c.T @ c / n)) < 1e-9 and r["n"] == n and r["identity_error"] < 1e-6
    z = c @ vector / np.sqrt(value)
    for k in range(components):
        mine = np.array([sorted(by_row[i, d][k + 1])[0] for i, d in sorted(by_row, key=str)])
        their = {(i, sum((n * int(a) - b) ** 2 for a, b in zip(row, s))): z[j, k] for j, ((i, _), row) in enumerate(zip(rows, x))}
        theirs = np.array([their[key] for key in sorted(by_row, key=str)])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-6, k


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(v) for v in rng.normal(0, 1, 10) * np.arange(1, 11)]) for i in range(700)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1])]
    odd = [(900, None), (901, []), (902, [1.0, None] + [0.0] * 8), (903, [float("nan")] + [0.0] * 9), (904, [float("inf")] + [0.0] * 9), (905, [1.0] * 9), (906, [1e30] + [0.0] * 9)]
    got = whiten(vectors(spark, rows + odd)).collect()
    assert len(got) == 8 * len(rows)
    check_whitened(got, rows, 8)


def test_several_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(op12_whitening, "CELLS", 64 * 6)
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(v) for v in rng.normal(0, 1, 6) + 3]) for i in range(1000)]
    assert op12_whitening.block_matrix(spark.range(1000).selectExpr("id AS i", "array(1D, 2D) AS z"), "z", 64, 1000, 2).numRowBlocks == 16
    got = whiten(vectors(spark, rows)).collect()
    assert len(got) == 6000  # no more components than dimensions
    check_whitened(got, rows, 6)


def test_whitening_without_variance_and_on_nothing(spark):
    got = whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(got) == 4 and all(r["whitened"] == 0 and r["deviation"] == 0 and r["explained"] == 0 for r in got)
    flat = whiten(vectors(spark, [(k, [float(k), 2.0]) for k in range(4)])).collect()
    assert {r["explained"] for r in flat} == {1.0, 0.0} and all(r["whitened"] == 0 for r in flat if r["component"] == 2)
    big = whiten(vectors(spark, [(k, [float(2**40 + k * 2**30), 2.0]) for k in range(4)])).collect()
    assert len(big) == 8 and all(r["deviation"] is None for r in big)
    for none in ([], [(1, None)]):
        assert whiten(vectors(spark, none)).count() == 0


def test_whitening_on_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    check_whitened(op12_block_whitening(spark, SF).collect(), good, 8)


# --- exact copies ------------------------------------------------------------------------------

COPIES = [(1, "Same Text", "a"), (2, "same text", "b"), (3, "same  text", "b"), (4, None, None), (5, "", "a"), (6, "É", "a"), (7, "é", "a"), (None, "SAME TEXT", "c"),
          (None, "alone null", "c"), (None, "two nulls", "c"), (None, "two nulls", "c"), (8, "word " * 60_000, "d"), (9, "Word " * 60_000, "d"), (10, "repeat", "e"), (10, "repeat", "e"),
          (11, "Repeat", "e"), (12, "K", "f"), (13, "k", "f"), (14, "other", "f")]


def brute_copies(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(brute.LOWER)].append(i)
    out = []
    for norm, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for j, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)):
            out.append((str(i), str(keep), len(ids), j == 0, brute.digest(norm)))
    return sorted(out)


def groups_told(df):
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


@pytest.mark.parametrize("words,hot", [(None, 10_000), (1, 10_000), (1024, 1), (1024, 3)])
def test_copies_match_plain_groups(spark, words, hot):
    hot_group = [(100 + k, ("Hot", "hOT")[k % 2] + " copy", "h") for k in range(300)] + [(500 + k, f"text {k}", "h") for k in range(300)]
    got = exact_groups(brute.documents(spark, COPIES + hot_group).repartition(7), words, hot)
    assert groups_told(got) == brute_copies(COPIES + hot_group)


def test_single_texts_pass_without_a_shuffle(spark):
    docs = brute.documents(spark, [(k, f"text number {k // 2 if k < 40 else k}", "s") for k in range(2000)]).repartition(5)
    got = exact_groups(docs)
    assert got.filter("group_size > 1 AND NOT possible").count() == 0 and got.filter("group_size > 1").count() == 40
    assert got.filter("possible").count() < 2000 * 0.05


def test_the_filter_is_bounded_and_misses_nothing(spark):
    assert filter_words(10**12) == op13_exact_dedup.WORDS and filter_words(0) == 1024
    rows = op13_exact_dedup.hashed(brute.documents(spark, [(k, "one" if k % 3 == 0 else str(k), "s") for k in range(90)]).repartition(30))
    assert repeated_bits(rows, 16).count() <= 16


def test_rows_that_stay(spark):
    docs = brute.documents(spark, COPIES)
    got = without_copies(docs)
    assert got.columns == docs.columns
    want = sorted(i for i, _, _, kept, _ in brute_copies(COPIES) if kept)
    assert sorted(set(str(r["doc_id"]) for r in got.collect())) == sorted(set(want))


def test_copies_on_the_table_and_on_nothing(spark):
    rows = [(r["doc_id"], r["text"], None) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert groups_told(op13_bloom_dedup(spark, SF)) == brute_copies(rows)
    assert exact_groups(brute.documents(spark, [])).count() == 0
