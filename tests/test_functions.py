"""Exact quantiles and row fingerprints against plain Python, with ties, nulls, collisions and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callstrata.functions import fingerprints, quantiles
from callstrata.operators import audit, cleaning

PROBS = (0.0, 0.03, 0.25, 0.5, 0.9, 1.0)


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_equal_numpy(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    a, b = rng.normal(size=3001), rng.integers(0, 3, 3001).astype(float)
    rows = [(float(x), float(y) if i % 7 else None, float("nan") if i % 5 == 0 else 1.0, None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    got = {(r["columna"], r["prob"]): r["valor"] for r in quantiles.exact_quantiles(df, ["a", "b", "c", "d"], PROBS, accuracy).collect()}
    assert len(got) == 4 * len(PROBS)
    for p in PROBS:
        assert got["a", p] == pytest.approx(np.quantile(a, p), abs=1e-12)
        assert got["b", p] == pytest.approx(np.quantile([y for i, y in enumerate(b) if i % 7], p))
        assert got["c", p] == 1.0 and got["d", p] is None


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    right = F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda c, p, k: right(c, F.array(F.lit(0.0), F.lit(0.01)), k))
    assert quantiles.exact_quantiles(df, ["v"], [0.5]).first()["valor"] == 499.5


def test_quantiles_of_nothing_and_flat_columns(spark):
    empty = spark.createDataFrame([], "v double")
    assert quantiles.exact_quantiles(empty, ["v"], [0.5]).collect()[0]["valor"] is None
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, v double")
    assert [r["v"] for r in quantiles.robust_scaled(flat, ["v"]).collect()] == [0.0, 0.0]


ROWS = [(1, "a", None, 0.0), (1, "a", None, -0.0), (1, None, "a", 0.0), (None, None, None, None), (None, None, None, None), (2, "b", "c", float("nan")),
        (2, "b", "c", float("nan")), (3, "x", "y", 1.5)]
SHAPE = "k long, s string, t string, v double"


def test_distinct_rows_equal_plain_distinct(spark):
    rng = random.Random(1)
    rows = ROWS + [(rng.randrange(40), rng.choice("ab"), None, float(rng.randrange(3))) for _ in range(400)] + [(7, "hot", "hot", 7.0)] * 500
    df = spark.createDataFrame(rows, SHAPE).repartition(6)
    want = sorted(map(str, df.dropDuplicates().collect()))
    assert sorted(map(str, fingerprints.distinct_rows(df).collect())) == want
    r = audit.duplicate_count(df).first()
    assert (r["duplicados"], r["filas"]) == (len(rows) - len(want), len(rows))
    c = cleaning.clean_report(df).first()
    assert (c["filas_iniciales"], c["filas_sin_nulos"], c["filas_finales"]) == (len(rows), len(rows) - 2, len(want) - 1)


def test_collisions_are_told_apart(spark):
    weak = lambda d: (F.lit(1), F.pmod(F.col("k"), F.lit(2)))
    df = spark.createDataFrame([(i, "s", None, 1.0) for i in range(50)] + [(3, "s", None, 1.0)], SHAPE)
    assert fingerprints.distinct_rows(df, weak).count() == 50
    assert fingerprints.count_rows(df, weak).first()["distintas"] == 50


def test_only_fingerprints_are_counted_over_the_shuffle(spark):
    df = spark.createDataFrame(ROWS, SHAPE)
    h1, h2 = fingerprints.fingerprint(df)
    plan = df.select(h1.alias("_h1"), h2.alias("_h2")).groupBy("_h1", "_h2").count()._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.splitlines() if "Exchange" in line)
    assert "_h1" in exchange and "s#" not in exchange
    assert fingerprints.count_rows(spark.createDataFrame([], SHAPE)).first()["filas"] == 0


def test_field_detection_moves_no_values(spark):
    """Scores equal those from all different values; the counting pass shuffles a row per column and task."""
    from callstrata.operators import mapping
    from callstrata.schema import FIELD_RULES, VALUE_WEIGHT

    rows = [(f"2024-01-{1 + i % 28:02d} 10:00:00", f"+5691234{i:04d}", ("in", "out", "Entrante", "otra cosa")[i % 4] if i % 5 else None, str(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string").repartition(4)
    counts, names = mapping.pattern_counts(df)
    by = {r["orden"]: r for r in counts.collect()}
    import re
    for i in range(4):
        values = [r[i].lower() for r in rows if r[i] is not None]
        assert by[i]["_n"] == len(values)
        for field, own in names.items():
            for name, pattern in zip(own, FIELD_RULES[field]["patterns"]):
                assert by[i][name] == sum(bool(re.match(f"(?:{pattern})", v)) for v in values), (i, name)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert all("valor" not in line for line in plan.splitlines() if "Exchange" in line)
    field = next(f for f, r in FIELD_RULES.items() if "values" in r)
    score = {r["columna"]: r["puntaje"] for r in mapping.field_scores(df).where(F.col("campo") == field).collect()}
    kinds = {r[2].lower() for r in rows if r[2]}
    share = sum(any(w in v for w in FIELD_RULES[field]["values"]) for v in kinds) / len(kinds)
    assert abs(score["c"] - share * VALUE_WEIGHT) < 1e-9 or score["c"] > share * VALUE_WEIGHT
    assert mapping.field_scores(spark.createDataFrame([], "FECHA string, x string")).count() == 2 * len(FIELD_RULES)
