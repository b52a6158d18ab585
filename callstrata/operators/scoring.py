"""System scores, states, diagnostics and reports over model results and run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callstrata.functions.dates import next_sunday
from callstrata.functions.stats import pct
from callstrata.messages import TEXT
from callstrata.operators.alerts import _fmt, _one, _rules
from callstrata.schema import BASE_MAE, DEGRADATION_PCT, GOAL_MAE, MAE_CRITICAL


def state_of(score: Column) -> Column:
    return (F.when(score >= 80, "EXCELENTE").when(score >= 60, "BUENO").when(score >= 40, "REQUIERE_ATENCION")
            .when(score.isNotNull(), "CRITICO").otherwise("DESCONOCIDO"))


def performance(weights: DataFrame, fc: DataFrame, alerts: DataFrame, goal: float = GOAL_MAE) -> DataFrame:
    """Per call type: weighted MAE, models, best model, predictions, alerts, checks, score; and the overall state."""
    mae, p = F.col("mae"), F.col("peso")
    by_type = weights.groupBy("serie").agg(
        F.try_divide(F.sum(F.when(mae > 0, mae * p)), F.sum(F.when(mae > 0, p))).alias("mae_ensemble"),
        F.count(F.lit(1)).alias("modelos_activos"),
        F.min(F.struct((-p).alias("v"), F.col("modelo").alias("m")))["m"].alias("mejor_modelo"))
    n_fc = fc.groupBy("serie").agg(F.count(F.lit(1)).alias("predicciones"))
    n_al = alerts.groupBy("serie").agg(F.count(F.lit(1)).alias("alertas"),
                                       F.count_if(F.col("severidad") == "CRITICA").alias("alertas_criticas"))
    joined = by_type.join(n_fc, "serie", "left").join(n_al, "serie", "left").fillna(
        0, ["predicciones", "alertas", "alertas_criticas"])
    every = Window.partitionBy(F.lit(1))  # one row per call type
    out = joined.withColumns({
        "ok_mae": F.coalesce(F.col("mae_ensemble") <= goal, F.lit(False)),
        "ok_modelos": F.col("modelos_activos") >= 3, "ok_predicciones": F.col("predicciones") >= 20})
    hits = sum((F.col(c).cast("int") for c in ("ok_modelos", "ok_predicciones")), F.col("ok_mae").cast("int"))
    return out.withColumn("score", hits / 3 * 100).withColumn("score_general", F.avg("score").over(every)).withColumn(
        "estado", state_of(F.col("score_general")))


def system_alerts(perf: DataFrame, runs: DataFrame) -> DataFrame:
    """Alerts on error level, number of models, many critical alerts, state, and drop against the last run."""
    def row(tipo, severidad, componente, mensaje, accion):
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(tipo).alias("tipo"), lit(severidad).alias("severidad"), lit(componente).alias("componente"),
                        lit(mensaje).alias("mensaje"), F.lit(accion).alias("accion"))

    s, mae = F.col("serie"), F.col("mae_ensemble")
    per_type = _rules(
        perf,
        (mae.isNull() | (mae > MAE_CRITICAL), row(
            "PERFORMANCE_CRITICA", "CRITICA", F.concat(F.lit("Modelos "), s),
            F.concat(F.lit(TEXT["mae_critico"]), F.coalesce(_fmt("%.2f", F.bround(mae, 2)), F.lit("inf")), F.lit(" en "), s,
                     F.lit(f" (umbral: {MAE_CRITICAL})")),
            TEXT["revisar_inmediatamente_calidad_datos"])),
        (F.col("modelos_activos") < 2, row(
            "MODELOS_INSUFICIENTES", "ALTA", F.concat(F.lit("Ensemble "), s),
            _fmt(TEXT["solo_modelos_activos"], F.col("modelos_activos"), s),
            TEXT["verificar_entrenamiento_modelos_adicionales"])),
        (F.col("alertas_criticas") > 5, row(
            "MULTIPLES_ALERTAS_CRITICAS", "CRITICA", F.concat(F.lit("Predicciones "), s),
            _fmt(TEXT["alertas_criticas_predicciones"], F.col("alertas_criticas"), s),
            TEXT["revisar_configuracion_umbrales_capacidad"])))
    # One row: the overall state next to the score of the latest stored run.
    last = runs.orderBy(F.desc("run_ts"), "serie").select("score").limit(1).scalar()
    overall = perf.agg(F.max("score_general").alias("score"), F.max("estado").alias("estado")).withColumn("previo", last)
    drop = F.when(F.col("previo") > 0, (F.col("previo") - F.col("score")) / F.col("previo") * 100)
    bad = F.col("estado").isin("CRITICO", "REQUIERE_ATENCION")
    whole = _rules(
        overall,
        (drop > DEGRADATION_PCT, row(
            "DEGRADACION_PERFORMANCE", "ALTA", "Sistema General",
            _fmt(TEXT["degradacion_performance_general"], _one(drop)),
            TEXT["investigar_causas_degradacion_reentrenar"])),
        (bad, row(
            "ESTADO_SISTEMA", F.when(F.col("estado") == "CRITICO", "CRITICA").otherwise("ALTA"), "Sistema",
            F.concat(F.lit(TEXT["sistema_estado"]), F.col("estado")), TEXT["revision_completa_sistema_requerida"])))
    return per_type.unionByName(whole)


def degradation(runs: DataFrame, by: str = "serie") -> DataFrame:
    """Score drop in percent against the previous run, flagged above the threshold."""
    prev = F.lag("score").over(Window.partitionBy(by).orderBy("run_ts"))
    return runs.withColumn("previo", prev).withColumn(
        "degradacion_pct", F.when(F.col("previo") > 0, (F.col("previo") - F.col("score")) / F.col("previo") * 100)
    ).withColumn("alerta", F.coalesce(F.col("degradacion_pct") > DEGRADATION_PCT, F.lit(False)))


def _last_week(runs: DataFrame, n: int = 7, by: str = "serie") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("run_ts"))
    return runs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)


def weekly_report(runs: DataFrame, n: int = 7, by: str = "serie") -> DataFrame:
    """Means, trend, stability and goals over the last ``n`` runs."""
    good = F.when(F.col("mae") > 0, F.col("mae"))
    return _last_week(runs, n, by).groupBy(by).agg(
        F.count(F.lit(1)).alias("corridas"), F.avg("score").alias("score_promedio"), F.avg(good).alias("mae_promedio"),
        (F.max_by("score", "run_ts") - F.min_by("score", "run_ts")).alias("mejora_score"),
        F.when(F.count(good) >= 2, F.stddev_pop(good)).otherwise(0.0).alias("estabilidad_mae")).withColumns({
            "cumple_score": F.col("score_promedio") >= 80,
            "cumple_mae": F.coalesce(F.col("mae_promedio") <= GOAL_MAE, F.lit(False))})


def recent_errors(runs: DataFrame, failures: DataFrame, ts: str, days: int = 7) -> Column:
    """Failures of the ``days`` days up to the last run, as a scalar."""
    last = runs.agg(F.max("run_ts")).scalar()
    at = F.col(ts)
    return failures.where((at <= last) & (at > last - F.make_dt_interval(F.lit(days)))).agg(F.count(F.lit(1))).scalar()


def weekly_recommendations(runs: DataFrame, errors: Column | int = 0, n: int = 7, by: str = "serie") -> DataFrame:
    """Advice when the score fell over the week, or when errors occurred; ``errors`` is their number."""
    errors = errors if isinstance(errors, Column) else F.lit(errors)
    week = _last_week(runs, n, by).groupBy(by).agg(
        F.min_by("score", "run_ts").alias("_a"), F.max_by("score", "run_ts").alias("_b"), F.count(F.lit(1)).alias("_n"))
    week = week.withColumn("_e", errors)
    row = lambda t, d, a: F.struct(F.lit(t).alias("tipo"), (d if isinstance(d, Column) else F.lit(d)).alias("descripcion"), F.lit(a).alias("accion"))
    found = F.array_compact(F.array(
        F.when((F.col("_n") >= 2) & (F.col("_b") < F.col("_a")), row(
            "TENDENCIA_NEGATIVA", TEXT["performance_descendente_durante_semana"],
            TEXT["investigar_causas_degradacion_planificar"])),
        F.when(F.col("_e") > 0, row("ESTABILIDAD", F.concat(F.col("_e").cast("string"), F.lit(TEXT["errores_recientes_detectados"])),
                                    TEXT["revisar_logs_fortalecer_monitoreo"]))))
    return week.select(by, F.inline(found))


def system_mae_mean(perf: DataFrame) -> DataFrame:
    return perf.agg(F.coalesce(F.avg(F.when(F.col("mae_ensemble") > 0, F.col("mae_ensemble"))), F.lit(0.0)).alias(
        "mae_promedio"))


def exec_recommendations(perf: DataFrame) -> DataFrame:
    """Advice by overall state and by the error of each call type."""
    def row(prioridad, area, titulo, descripcion, impacto):
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(prioridad).alias("prioridad"), F.lit(area).alias("area"), lit(titulo).alias("titulo"),
                        lit(descripcion).alias("descripcion"), F.lit(impacto).alias("impacto_negocio"))

    whole = _rules(
        perf.agg(F.max("estado").alias("estado")),
        (F.col("estado") == "EXCELENTE", row(
            "BAJA", "OPERACIONES", TEXT["mantener_excelencia_operativa"],
            TEXT["sistema_funcionando_optimamente_mantener"], "MANTENIMIENTO")),
        (F.col("estado") == "CRITICO", row(
            "CRITICA", "TECNOLOGIA", TEXT["intervencion_inmediata_requerida"],
            TEXT["performance_debajo_estandares_minimos"], "ALTO_RIESGO")))
    s, mae = F.col("serie"), F.col("mae_ensemble")
    each = _rules(perf, (mae.isNull() | (mae > 20), row(
        "ALTA", "CALL_CENTER", F.concat(F.lit(TEXT["mejorar_predicciones"]), s),
        F.concat(F.lit("MAE de "), F.coalesce(_fmt("%.1f", _one(mae)), F.lit("inf")), F.lit(" en "), s,
                 F.lit(TEXT["requiere_optimizacion"])), "EFICIENCIA_OPERATIVA")))
    return whole.unionByName(each)


def technical_diagnostics(weights: DataFrame, fc: DataFrame) -> DataFrame:
    """Weight balance, spread of model errors, quality of the forecast, and the advice that follows."""
    good = F.when(F.col("mae") > 0, F.col("mae"))
    w = weights.groupBy("serie").agg(
        F.max("peso").alias("peso_maximo"), F.count(F.lit(1)).alias("modelos"),
        F.try_divide(F.stddev_pop(good), F.avg(good)).alias("variabilidad"))
    y = F.col("yhat_ensemble")
    q = fc.groupBy("serie").agg(
        (F.count(F.lit(1)) >= 20).alias("completitud"),
        F.coalesce(F.try_divide(F.stddev_samp(y), F.avg(y)) < 1, F.lit(False)).alias("consistencia"),
        F.bool_and(y >= 0).alias("valores_validos"),
        F.bool_and(F.col("yhat_upper") > F.col("yhat_lower")).alias("intervalos_consistentes"))
    checks = ["completitud", "consistencia", "valores_validos", "intervalos_consistentes"]
    m, v, s = F.col("peso_maximo"), F.col("variabilidad"), F.col("score_calidad")
    return w.join(q, "serie").withColumn(
        "score_calidad", sum((F.col(c).cast("int") for c in checks[1:]), F.col(checks[0]).cast("int")) / 4 * 100
    ).withColumns({
        "balance": F.when(m > 0.7, "DESBALANCEADO").when(m > 0.5, "MODERADAMENTE_BALANCEADO").otherwise("BIEN_BALANCEADO"),
        "balance_score": F.when(m > 0.7, 30).when(m > 0.5, 70).otherwise(90),
        "estabilidad": F.when(v.isNull(), "NO_METRICS").when(v < 0.2, "ESTABLE").when(
            v < 0.5, "MODERADAMENTE_ESTABLE").otherwise("INESTABLE"),
        "estabilidad_score": F.when(v.isNull(), 0).when(v < 0.2, 90).when(v < 0.5, 70).otherwise(30),
        "calidad": F.when(s >= 75, "BUENA").when(s >= 50, "REGULAR").otherwise("MALA"),
        "recomienda_balance": m > 0.6, "recomienda_diversidad": F.col("modelos") < 3})


def business_impact(perf: DataFrame) -> DataFrame:
    """Savings, satisfaction, overtime and return by score band."""
    s = F.col("score_general")
    band = lambda a, b: F.when(s >= 80, a).when(s >= 60, b).otherwise(0)
    return perf.agg(F.max("score_general").alias("score_general")).withColumns({
        "ahorro_mensual_usd": band(15000, 8000), "mejora_satisfaccion_pct": band(15, 8),
        "reduccion_overtime_pct": band(25, 15),
        "roi_anual_pct": band(15000, 8000) * 12 / F.lit(75000.0) * 100})


def baseline_improvement(perf: DataFrame) -> DataFrame:
    """Improvement of the mean error over the level before the project."""
    return system_mae_mean(perf).select(
        "mae_promedio", F.greatest(F.lit(0.0), (BASE_MAE - F.col("mae_promedio")) / BASE_MAE * 100).alias("mejora_mae_pct"),
        F.lit(BASE_MAE).alias("baseline_mae"), (F.col("mae_promedio") <= GOAL_MAE).alias("objetivo_alcanzado"))


def weekly_validation(metrics: DataFrame, types: list[str], limit: float = 20.0) -> DataFrame:
    """Per call type the smallest model error and its problem; the state counts the problems."""
    spark = metrics.sparkSession
    wanted = spark.createDataFrame([(t,) for t in types], "serie string").coalesce(1)
    best = metrics.groupBy("serie").agg(F.min("mae").alias("mae_minimo"))
    every = Window.partitionBy(F.lit(1))  # one row per call type
    problem = (F.when(F.col("mae_minimo").isNull(), F.concat(F.lit(TEXT["sin_resultados"]), F.col("serie")))
               .when(F.col("mae_minimo") > limit, F.concat(F.lit(TEXT["performance_baja"]), F.col("serie"))))
    n = F.count("problema").over(every)
    return F.broadcast(wanted).join(best, "serie", "left").withColumn("problema", problem).withColumn(
        "estado", F.when(n > 2, "CRITICO").when(n > 0, "ATENCION").otherwise("OK"))


def run_freshness(runs: DataFrame, as_of: str, limit_hours: float = 36.0, by: str = "serie") -> DataFrame:
    """Hours since the last run; more than the limit is a problem."""
    now = F.lit(as_of).cast("timestamp_ntz")
    last = runs.groupBy(by).agg(F.max("run_ts").alias("ultima"))
    hours = F.timestamp_diff("SECOND", F.col("ultima"), now) / 3600.0
    every = Window.partitionBy(F.lit(1))  # one row per series
    late = F.col("horas") > limit_hours
    n = F.sum(late.cast("int")).over(every)
    return last.withColumn("horas", hours).withColumn("problema", late).withColumn(
        "estado", F.when(n == 0, "OK").when(n <= 2, "DEGRADADO").otherwise("CRITICO"))


def next_retrain(runs: DataFrame, by: str = "serie") -> DataFrame:
    """The Sunday after the last run and the days until then."""
    last = runs.groupBy(by).agg(F.to_date(F.max("run_ts")).alias("hoy"))
    return last.withColumn("fecha_programada", next_sunday(F.col("hoy"))).withColumn(
        "dias_restantes", F.datediff("fecha_programada", "hoy"))


def result_overview(weights: DataFrame, fc: DataFrame, daily: DataFrame) -> DataFrame:
    """Records, models and predictions of a result set."""
    def part(df, name, value):
        return df.agg(value.cast("long").alias("n")).select(F.lit(name).alias("elemento"), "n")
    return part(daily, "registros", F.sum("y")).unionByName(part(weights, "modelos", F.count(F.lit(1)))).unionByName(
        part(fc, "predicciones", F.count(F.lit(1))))


# --- service usage -----------------------------------------------------------------------------

def api_usage(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Totals, latency and success of the calls since ``days`` before ``as_of``."""
    recent = log.where(F.col("created_at") >= F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz"))
    n, ok = F.count(F.lit(1)), F.count_if("success")
    return recent.groupBy("api_provider").agg(
        n.alias("total"), ok.alias("exitosas"), (n - ok).alias("fallidas"), F.avg("response_time_ms").alias("latencia_media"),
        F.sum("records_retrieved").alias("registros"), F.max("created_at").alias("ultima"), pct(ok, n).alias("pct_exito"))


def api_daily(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    recent = log.where(F.col("created_at") >= F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz"))
    return recent.groupBy(F.to_date("created_at").alias("ds")).agg(
        F.count(F.lit(1)).alias("llamadas"), F.count_if("success").alias("exitosas"))


def api_top_endpoints(log: DataFrame, n: int = 5) -> DataFrame:
    return log.groupBy("endpoint").agg(F.count(F.lit(1)).alias("llamadas")).orderBy(F.desc("llamadas"), "endpoint").limit(n)


def integration_health(usage: DataFrame) -> DataFrame:
    """Latency below 2 s and success above 95 % make a healthy integration."""
    slow, bad = F.col("latencia_media") >= 2000, F.col("pct_exito") <= 95
    return usage.select("api_provider", "latencia_media", "pct_exito", (~slow).alias("latencia_ok"), (~bad).alias("exito_ok"),
                        F.when(~slow & ~bad, "OK").when(slow & bad, "CRITICO").otherwise("ATENCION").alias("estado"))


def audit_calls(log: DataFrame, provider: str, since: str, limit: int | None = None) -> DataFrame:
    """Calls of one provider since a date, newest first; the filters reach the scan."""
    out = log.where((F.col("api_provider") == provider) & (F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))).orderBy(
        F.desc("created_at"), F.desc("id"))
    return out.limit(limit) if limit else out


def sync_summary(ops: DataFrame, by: str = "run") -> DataFrame:
    """Operations of each run, their success share and the resulting state."""
    n, ok = F.count(F.lit(1)), F.count_if("success")
    return ops.groupBy(by).agg(n.alias("total"), ok.alias("exitosas"), (n - ok).alias("fallidas"), pct(ok, n).alias("pct_exito")).withColumn(
        "estado", F.when(F.col("fallidas") == 0, "success").when(F.col("exitosas") > 0, "partial").otherwise("failed"))


def session_stats(sessions: DataFrame, as_of: str) -> DataFrame:
    """Sessions, completed ones, mean records and those of the last seven days."""
    end = F.lit(as_of).cast("timestamp_ntz")
    records = F.get_json_object("file_info", "$.records_count").cast("long")
    return sessions.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completadas"),
        F.avg(F.coalesce(records, F.lit(0))).alias("promedio_registros"),
        F.count_if(F.col("created_at") > end - F.expr("INTERVAL 7 DAYS")).alias("ultima_semana"))


def sessions_per_day(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(F.to_date("created_at").alias("fecha")).agg(F.count(F.lit(1)).alias("sesiones"))


def paginate(sessions: DataFrame, page: int, size: int, user: int | None = None, status: str | None = None) -> DataFrame:
    """One page, newest first, with the true total; size 1-100.

    A sort of ``page * size`` rows per task: meant for the first pages. ``page_after`` goes as deep as one likes.
    """
    if not 1 <= size <= 100:
        raise ValueError("page size must be between 1 and 100")
    if user is not None:
        sessions = sessions.where(F.col("user_id") == user)
    if status is not None:
        sessions = sessions.where(F.col("status") == status)
    total = sessions.agg(F.count(F.lit(1)).alias("total")).scalar()
    return sessions.orderBy(F.desc("created_at"), "session_id").offset((page - 1) * size).limit(size).withColumn("total", total)


def page_after(sessions: DataFrame, size: int, after: tuple[str, int] | None = None, user: int | None = None, status: str | None = None) -> DataFrame:
    """The page that follows the row ``after`` (its created_at and session_id), newest first; None starts at the top.

    The row is a filter, so each page sorts ``size`` rows per task however deep it lies.
    """
    if not 1 <= size <= 100:
        raise ValueError("page size must be between 1 and 100")
    if user is not None:
        sessions = sessions.where(F.col("user_id") == user)
    if status is not None:
        sessions = sessions.where(F.col("status") == status)
    if after is not None:
        at = F.lit(after[0]).cast("timestamp_ntz")
        sessions = sessions.where((F.col("created_at") < at) | (F.col("created_at") == at) & (F.col("session_id") > after[1]))
    return sessions.orderBy(F.desc("created_at"), "session_id").limit(size)
