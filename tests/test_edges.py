"""Hand-made frames for ties, gaps, nulls, single rows and calendar corners."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from callstrata.functions import dates, numbering, stats
from callstrata.operators import alerts, audit, calendar, cleaning, ensemble, features, governance, insight, mapping, scoring, segment
from callstrata.sources.holidays import enrich, holiday_dim

D = dt.date


def series(spark, values, start=D(2024, 1, 1), serie="in", step=1):
    rows = [(serie, start + dt.timedelta(days=i * step), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "serie string, ds date, y bigint")


def test_single_row_and_constant_series(spark):
    one = insight.stability_flags(series(spark, [5])).first()
    assert one["desv_7"] is None and one["es_anomalia"] is False
    flat = insight.stability(series(spark, [4] * 20)).first()
    assert (flat["cv_pct"], flat["anomalias"], flat["tendencia"], flat["estabilidad"]) == (0.0, 0, "estable", "alta")
    z = features.centered_zscore(series(spark, [4] * 20)).where("z_score is not null").count()
    assert z == 0
    zero = insight.stability(series(spark, [0, 0, 0])).first()
    assert zero["cv_pct"] is None


def test_calendar_fills_gaps_of_seven_and_eight(spark):
    df = spark.createDataFrame([("in", D(2024, 1, 1), 3, 2), ("in", D(2024, 1, 8), 1, 1), ("in", D(2024, 1, 16), 2, 0),
                                ("out", D(2024, 2, 1), 9, 9)], "serie string, ds date, y bigint, atendidas bigint")
    full = calendar.complete_calendar(df)
    assert full.where("serie = 'in'").count() == 16 and full.where("serie = 'out'").count() == 1
    assert full.agg(F.sum("y")).first()[0] == 15
    gaps = insight.temporal_gaps(df, 7).collect()
    assert [(r["desde"], r["dias"]) for r in gaps] == [(D(2024, 1, 8), 8)]
    weekdays = calendar.complete_calendar(df, weekdays_only=True)
    assert weekdays.where("weekday(ds) > 4").count() == 0


def test_ties_take_the_smallest_key(spark):
    df = spark.createDataFrame([(3, 7), (1, 7), (2, 0), (5, 0)], "k int, v int")
    r = df.agg(stats.arg_max("k", "v").alias("a"), stats.arg_min("k", "v").alias("b")).first()
    assert (r["a"], r["b"]) == (1, 2)


def test_completeness_duplicates_and_outliers(spark):
    rows = [(None, 1.0)] * 2 + [(None, -1.0), (None, 0.0)] + [(None, 1.0 + i / 100) for i in range(20)] + [(None, 500.0)]
    df = spark.createDataFrame(rows, "a string, x double")
    c = {r["columna"]: r for r in audit.completeness(df).collect()}
    assert c["a"]["score"] == 0 and c["x"]["score"] == 100 and c["a"]["score_promedio"] == 50
    d = audit.duplicate_count(df).first()
    assert (d["duplicados"], d["filas"]) == (2, 25)
    q = audit.numeric_quality(df, ["x"]).first()
    assert (q["negativos"], q["ceros"], q["atipicos"]) == (1, 1, 1)


def test_clean_report_counts_null_rows_and_copies(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, None), (2, None)], "a int, b string")
    assert cleaning.clean_report(df).first().asDict() == {"filas_iniciales": 5, "filas_sin_nulos": 3, "filas_finales": 2}
    assert cleaning.clean_rows(df).count() == 2


@pytest.mark.parametrize("day,expected", [
    (D(2024, 6, 10), "Feriado (Otro)"),       # Monday
    (D(2024, 6, 14), "Feriado (Otro)"),       # Friday
    (D(2024, 6, 15), "Fin de Semana Largo"),  # Saturday after a Friday holiday
    (D(2024, 6, 9), "Fin de Semana Largo"),   # Sunday before a Monday holiday
    (D(2024, 6, 8), "Fin de Semana"),
    (D(2024, 6, 11), "Post-Feriado"),
    (D(2024, 6, 13), "Pre-Feriado"),
    (D(2024, 6, 18), "Pre-Feriado"),
    (D(2024, 6, 19), "Feriado (Otro)"),       # consecutive holidays
    (D(2024, 6, 20), "Feriado (Otro)"),
    (D(2024, 6, 21), "Post-Feriado"),
    (D(2024, 6, 12), "Día Laboral"),
])
def test_day_types(spark, day, expected):
    hol = enrich(spark.createDataFrame([(D(2024, 6, d), "x") for d in (10, 14, 19, 20)], "fecha date, descripcion string"))
    got = calendar.mark_days(spark.createDataFrame([(day,)], "ds date"), hol).first()
    assert got["tipo_dia"] == expected
    assert got["fin_semana_largo"] == (day in (D(2024, 6, 10), D(2024, 6, 14), D(2024, 6, 15), D(2024, 6, 9)))


def test_national_holidays(spark):
    per = {r["categoria"]: r["count"] for r in holiday_dim(spark).groupBy("categoria").count().collect()}
    assert per == {"Religioso": 25, "Cívico": 13, "Electoral": 3, "Cultural": 6, "Otro": 6}
    years = {r["anio"]: r["count"] for r in holiday_dim(spark).groupBy("anio").count().collect()}
    assert years == {2023: 18, 2024: 19, 2025: 16}


def test_iso_week_label(spark):
    df = spark.createDataFrame([(D(2024, 12, 30),), (D(2025, 1, 1),), (D(2024, 1, 1),)], "d date")
    assert [r[0] for r in df.select(dates.week_label(F.col("d"))).collect()] == ["2025-S01", "2025-S01", "2024-S01"]


def test_direction_rules_by_hour(spark):
    rows = [(None, dt.datetime(2024, 1, 1, h)) for h in (7, 8, 17, 18, 19, 20)] + [("in", None), ("out", None), (None, None)]
    got = segment.segment_calls(spark.createDataFrame(rows, "SENTIDO string, FECHA timestamp_ntz")).collect()
    assert [(r["tipo_llamada"], round(r["confianza_segmentacion"], 6)) for r in got] == [
        ("SALIENTE", 0.9), ("ENTRANTE", 0.8), ("ENTRANTE", 0.8), ("SALIENTE", 0.7), ("SALIENTE", 0.7), ("SALIENTE", 0.9),
        ("ENTRANTE", 0.9), ("SALIENTE", 0.9), ("INDETERMINADA", 0.0)]


def test_dates_that_do_not_parse(spark):
    df = spark.createDataFrame([("31-12-2023 10:11:12",), ("31-02-2023 10:11:12",), ("xx",), (None,), ("01/02/2024 00:00:01",)], "FECHA_TXT string")
    assert cleaning.parse_report(df).first().asDict() == {"total": 5, "validas": 2, "invalidas": 3}
    assert cleaning.parse_calls(df).agg(F.max("FECHA")).first()[0] == dt.datetime(2024, 2, 1, 0, 0, 1)


def test_mape_skips_days_without_calls(spark):
    pairs = spark.createDataFrame([("in", "m", 0, 2.0), ("in", "m", 4, 2.0), ("in", "m", 2, 2.0)], "serie string, modelo string, y bigint, yhat double")
    r = ensemble.error_metrics(pairs).first()
    assert (r["dias_cero"], r["mape"], round(r["mae"], 6)) == (1, 25.0, 1.333333)
    flat = ensemble.error_metrics(pairs.where("y = 2")).first()
    assert flat["r2"] is None


def test_weights_are_clipped_and_sum_to_one(spark):
    m = spark.createDataFrame([("in", "a", 1.0), ("in", "b", 10.0), ("in", "c", 100.0), ("out", "a", 3.0)], "serie string, modelo string, mae double")
    w = {(r["serie"], r["modelo"]): r["peso"] for r in ensemble.ensemble_weights(m).collect()}
    assert w[("out", "a")] == 1.0
    assert abs(w[("in", "a")] - 0.5 / 0.7) < 1e-12 and abs(w[("in", "c")] - 0.1 / 0.7) < 1e-12
    s = {(r["serie"], r["modelo"]): r["peso"] for r in ensemble.simple_weights(m).collect()}
    assert abs(s[("in", "a")] - 1 / 1.11) < 1e-12


@pytest.mark.parametrize("n", [29, 30, 59, 60])
def test_minimum_rows(spark, n):
    s = series(spark, list(range(n)))
    assert cleaning.min_rows(s).count() == (n if n >= 30 else 0)
    assert insight.period_compare(s).count() == (1 if n >= 60 else 0)
    pairs = s.select("serie", "ds", "y", F.lit("m").alias("modelo"), F.lit(1.0).alias("yhat"))
    assert insight.residuals(pairs).count() == (30 if n >= 30 else 0)


@pytest.mark.parametrize("limit", [1000, 2001, 2002, 2500, 5000, 7000, 9000])
def test_downsample_keeps_ends_and_even_steps(spark, limit):
    import numpy as np
    n = 7000
    s = spark.range(n).select(F.lit("in").alias("serie"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("ds"), F.col("id").alias("y"))
    got = sorted(r["y"] for r in insight.downsample(s, limit).collect())
    if n <= limit:
        want = list(range(n))
    else:
        room = limit - 2000
        mid = [] if room <= 0 else [1000 + int(i) for i in np.linspace(0, n - 2000 - 1, room, dtype=int)]
        want = sorted(set(range(1000)) | set(mid) | set(range(n - 1000, n)))
    assert got == want


def test_field_detection(spark):
    df = spark.createDataFrame([("01-02-2024 10:00:00", "+56911112222", "in", "10"), ("02-02-2024 11:00:00", "+56911113333", "out", "20")],
                               "fecha_llamada string, numero string, sentido string, x string")
    got = {r["campo"]: r["columna"] for r in mapping.detect_fields(df).collect()}
    assert got["FECHA"] == "fecha_llamada" and got["TELEFONO"] == "numero" and got["SENTIDO"] == "sentido"
    assert mapping.validate_mapping({"FECHA": "a", "TELEFONO": "a", "SENTIDO": None}, ["a"]) == ["falta SENTIDO", "columna repetida a"]


def test_alias_mapping_ignores_case():
    found = mapping.map_aliases(["Fecha", "USER", "x"], {"fecha": ["fecha", "date"], "agente": ["agente", "user"], "tipo": ["tipo"]})
    assert found == {"fecha": "Fecha", "agente": "USER", "tipo": None}


def test_clean_users_defaults(spark):
    df = spark.createDataFrame([(1, " 123456 ", "None", "Jefe "), (2, "12345", "x", "A"), (3, "1234567", " ", "B")], "id int, TELEFONO string, USUARIO string, CARGO string")
    got = sorted(tuple(r) for r in mapping.clean_users(df, "id", "SIN").collect())
    assert got == [("123456", "SIN", "Jefe"), ("1234567", "SIN", "B")]


def test_sanitize(spark):
    text = 'error PASSWORD="abc" at /home/user/x token: zzz C:\\secret\\p Python 3.11.2\nTraceback'
    clean = lambda *t: [r["o"] for r in spark.createDataFrame([(x,) for x in t], "t string").select(governance.sanitize(F.col("t")).alias("o")).collect()]
    got = clean(text)[0]
    for gone in ("abc", "/home", "zzz", "3.11.2", "Traceback", "secret\\p"):
        assert gone not in got
    assert got.endswith("[Stack trace removed in production]")


def test_sanitize_equals_plain_regular_expressions(spark):
    import random
    import re

    from callstrata.schema import LONG_PATH, LONG_PATH_MARK, SENSITIVE, SENSITIVE_MARK, TRACE_MARK

    def plain(t):
        for p, _ in SENSITIVE:
            t = re.sub(p, SENSITIVE_MARK, t, flags=re.IGNORECASE)
        t = re.sub(LONG_PATH, LONG_PATH_MARK, t)
        return t.split("\n")[0] + TRACE_MARK if "\n" in t else t

    rnd = random.Random(1)
    bits = ["password", "pa\u017f\u017fword", "to\u212aen", "TOKEN", "key", "secret", "mysql://u", "postgresql://", "MONGODB://x", "c:\\tmp", "/home/a", "/VAR/", "/usr/lib",
            'File "a.py", line 3', 'F\u0130LE "b", l\u0131ne 4', "at foo (b.js)", "Python 3.1.2", "uv\u0131corn 1.2.3", "fastapi 0.1.1", ":", "=", '"', " ", " ", "\n", "x", "/abcdefghij_klmnopqrst-uv", "[", "("]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["o"] for r in df.select("i", governance.sanitize(F.col("t")).alias("o")).collect()}
    bad = [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)]
    assert not bad, bad[:3]


def test_file_rules(spark):
    rows = [("a.csv", 500, 3, "x;y"), ("nul.CSV", 500, 3, "x;y"), ("a.csv", 99, 3, "x;y"), ("a.csv", 60_000_000, 3, "x;y"), ("a.pdf", 500, 3, "x;y"),
            ("a.csv", 500, 1, "x;y"), ("a.csv", 500, 3, "xy"), ("a.xlsx", 500, 0, ""), (".a.csv", 500, 3, "x;y"), ("a..csv", 500, 3, "x;y"), ("", 500, 3, "x;y")]
    v = governance.file_verdicts(spark.createDataFrame(rows, "nombre string, bytes bigint, lineas int, cabecera string"))
    assert [r["motivo"] for r in v.collect()] == [None, "nombre reservado", "demasiado pequeño", "demasiado grande", "tipo no permitido", "menos de dos líneas",
                                                 "sin separador", "hoja corrupta", "archivo oculto", "caracter no permitido", "nombre requerido"]
    s = governance.file_stats(v).first()
    assert (s["aceptados"], s["rechazados"]) == (1, 10)


def test_zero_prediction_alert(spark):
    fc = spark.createDataFrame([("in", D(2024, 1, 2), 0.0, 1.0)], "serie string, ds date, yhat_ensemble double, yhat_std double")
    got = alerts.demand_alerts(fc, series(spark, [1, 2, 3])).collect()
    assert {r["tipo"] for r in got} == {"ALTA_INCERTIDUMBRE", "DEMANDA_BAJA"}


def test_rising_tail_needs_five_rows(spark):
    up = lambda k: spark.createDataFrame([("in", D(2024, 1, 1 + i), float(i)) for i in range(k)], "serie string, ds date, yhat_ensemble double")
    assert [alerts.rising_tail(up(k)).first()["creciente"] for k in (4, 5, 9)] == [False, True, True]


def test_next_sunday(spark):
    df = spark.createDataFrame([(D(2024, 1, 6),), (D(2024, 1, 7),)], "d date")
    assert [r[0] for r in df.select(dates.next_sunday(F.col("d"))).collect()] == [D(2024, 1, 7), D(2024, 1, 14)]


def test_page_size_is_checked(spark):
    with pytest.raises(ValueError):
        scoring.paginate(spark.range(1), 1, 101)


def test_order_of_rows(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 5, 4, 9, 3, 7, 8])], "s bigint, v int")
    for width in (1, 2, 3, 100):
        r = numbering.disorder(df, "s", "v", width).first()
        assert (r["filas"], r["retrocesos"], r["ordenado"]) == (8, 2, False)


def test_forecast_lies_after_history(spark):
    s = series(spark, list(range(60)))
    fc = ensemble.baseline_forecast(s, holiday_dim(spark), 28)
    assert fc.count() == 28 and ensemble.no_overlap(fc, s).first()["valido"]
    assert calendar.future_days(s, 28, business=True).where("weekday(ds) > 4").count() == 0
