"""Deterministic forecast, ensemble, alert and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callstrata.operators import alerts, audit, calendar, ensemble, insight, scoring
from callstrata.plans.fixtures import AS_OF_LONG, SIMPLE_MODELS, Views
from callstrata.plans.registry import query


def rows():
    return F.count(F.lit(1))


@query("future_all_days", "SELECT serie, ds FROM future")
def _(v: Views):
    return calendar.future_days(v.daily, 28)


@query("future_business_days", """SELECT serie, ds FROM (SELECT *, row_number() OVER (PARTITION BY serie ORDER BY ds) AS r FROM (SELECT serie,
  CAST(unnest(generate_series(l + INTERVAL 1 DAY, l + INTERVAL 60 DAY, INTERVAL 1 DAY)) AS DATE) AS ds FROM (SELECT serie, max(ds) l FROM daily GROUP BY 1))
  WHERE isodow(ds)<=5) WHERE r<=28""")
def _(v: Views):
    return calendar.future_days(v.daily, 28, business=True)


_BASE = """SELECT f.serie, f.ds, coalesce(w.m, o.m) AS base FROM future f JOIN (SELECT serie, avg(y) m FROM daily GROUP BY 1) o USING (serie)
  LEFT JOIN (SELECT serie, isodow(ds) d, avg(y) m FROM daily GROUP BY 1,2) w ON w.serie=f.serie AND w.d=isodow(f.ds)"""


@query("weekday_mean_lookup", _BASE, dbl="base")
def _(v: Views):
    return ensemble.weekday_baseline(calendar.future_days(v.daily_table, 28), v.daily_table)


@query("baseline_forecast", f"""SELECT serie, ds, es_feriado, round(p,1) AS yhat_ensemble, round(p*0.85,1) AS yhat_lower, round(p*1.15,1) AS yhat_upper FROM
  (SELECT b.serie, b.ds, coalesce(n.es_feriado,false) AS es_feriado, greatest(0.0, base*CASE WHEN NOT coalesce(n.es_feriado,false) THEN 1.0
    WHEN b.serie='out' THEN 0.3 ELSE 0.7 END) AS p FROM ({_BASE}) b LEFT JOIN near_long n ON b.ds=n.f)""", dbl="yhat_ensemble yhat_lower yhat_upper")
def _(v: Views):
    return ensemble.baseline_forecast(v.daily_table, v.hol_long)


_MET = "mae rmse mape r2"


@query("error_metrics", "SELECT * FROM metrics", dbl=_MET)
def _(v: Views):
    return v.metrics


@query("metric_interpretation", """SELECT serie, modelo, r2, mape, CASE WHEN r2>0.85 THEN 'Excelente' WHEN r2>=0.80 THEN 'Bueno' ELSE 'Mejorable' END AS clase_r2,
  CASE WHEN mape<12 THEN 'Excelente' WHEN mape<=15 THEN 'Aceptable' ELSE 'Mejorable' END AS clase_mape FROM metrics""", dbl="r2 mape")
def _(v: Views):
    return ensemble.interpret(v.metrics)


@query("model_ranking", """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY serie ORDER BY r2 DESC, modelo) AS INTEGER) AS puesto FROM metrics)
  WHERE puesto<=3""", dbl=_MET)
def _(v: Views):
    return ensemble.rank_models(v.metrics)


_RES = """SELECT serie, modelo, ds, y, yhat, y-yhat AS residual FROM (SELECT *, row_number() OVER (PARTITION BY serie, modelo ORDER BY ds DESC) r,
  count(*) OVER (PARTITION BY serie, modelo) c FROM pairs) WHERE r<=30 AND c>=30"""


@query("residuals", _RES, dbl="yhat residual")
def _(v: Views):
    return insight.residuals(v.pairs)


@query("residual_stats", f"""SELECT serie, modelo, avg(residual) AS media, stddev_samp(residual) AS desviacion, min(residual) AS minimo, max(residual) AS maximo,
  count(*) AS n FROM ({_RES}) GROUP BY 1,2""", dbl="media desviacion minimo maximo")
def _(v: Views):
    return insight.residual_stats(insight.residuals(v.pairs))


@query("residual_histogram", f"""SELECT serie, modelo, CAST(coalesce(least(floor((residual-lo)*15/nullif(hi-lo,0))+1,15),1) AS INTEGER) AS tramo, count(*) AS n FROM
  (SELECT *, min(residual) OVER (PARTITION BY serie, modelo) lo, max(residual) OVER (PARTITION BY serie, modelo) hi FROM ({_RES})) GROUP BY 1,2,3""")
def _(v: Views):
    return insight.residual_histogram(insight.residuals(v.pairs))


@query("time_split", """SELECT serie, ds, y, CASE WHEN r<=floor(n*0.8) THEN 'train' ELSE 'test' END AS parte FROM (SELECT serie, ds, y,
  count(*) OVER (PARTITION BY serie) n, row_number() OVER (PARTITION BY serie ORDER BY ds) r FROM daily)""")
def _(v: Views):
    return ensemble.time_split(v.daily.select("serie", "ds", "y"))


_NUM = "(SELECT serie, ds, y, count(*) OVER (PARTITION BY serie) n, row_number() OVER (PARTITION BY serie ORDER BY ds) r FROM daily)"


@query("cv_folds", f"""SELECT serie, ds, y, fold, parte FROM (SELECT *, CASE WHEN r<=te-sz-7 THEN 'train' WHEN r>te-sz AND r<=te THEN 'test' END AS parte FROM
  (SELECT *, n//6 AS sz, n-fold*(n//6) AS te FROM {_NUM}, (VALUES (0),(1),(2),(3),(4)) f(fold))) WHERE parte IS NOT NULL AND te-sz-7>=sz""")
def _(v: Views):
    return ensemble.cv_folds(v.daily.select("serie", "ds", "y"))


@query("expanding_folds", f"""SELECT serie, ds, y, fold, parte FROM (SELECT *, CASE WHEN r<=st THEN 'train' WHEN r<=st+sz THEN 'test' END AS parte FROM
  (SELECT *, n//6 AS sz, n-(5-fold)*(n//6) AS st FROM {_NUM}, (VALUES (0),(1),(2),(3),(4)) f(fold))) WHERE parte IS NOT NULL""")
def _(v: Views):
    return ensemble.expanding_folds(v.daily.select("serie", "ds", "y"))


@query("expanding_folds_short", """SELECT serie, ds, y, fold, CASE WHEN r>lo AND r<=lo+sm+CASE WHEN fold<ex THEN 1 ELSE 0 END THEN 'test' ELSE 'train' END AS parte FROM
  (SELECT *, n//5 AS sm, n%5 AS ex, fold*(n//5)+least(fold,n%5) AS lo FROM (SELECT serie, ds, y, count(*) OVER (PARTITION BY serie) n,
   row_number() OVER (PARTITION BY serie ORDER BY ds) r FROM days_calls), (VALUES (0),(1),(2),(3),(4)) f(fold))""")
def _(v: Views):
    return ensemble.expanding_folds(v.days_calls.select("serie", "ds", "y"))


@query("ensemble_weights", "SELECT serie, modelo, mae, peso FROM weights", dbl="mae peso")
def _(v: Views):
    return v.weights


@query("simple_weights", """SELECT serie, modelo, mae, s/sum(s) OVER (PARTITION BY serie) AS peso FROM
  (SELECT *, min(mae) OVER (PARTITION BY serie)/mae AS s FROM metrics)""", dbl="mae peso")
def _(v: Views):
    return ensemble.simple_weights(v.metrics)


@query("ensemble_combine", """SELECT f.serie, f.ds, sum(peso*yhat)/sum(peso) AS yhat_ensemble FROM forecast f JOIN weights w USING (serie, modelo) GROUP BY 1,2""",
       dbl="yhat_ensemble")
def _(v: Views):
    return ensemble.combine(v.forecast, v.weights)


@query("model_spread_interval", """SELECT serie, ds, avg(yhat) AS yhat_media, stddev_pop(yhat) AS yhat_std, greatest(0.0, avg(yhat)-1.96*stddev_pop(yhat)) AS yhat_lower,
  avg(yhat)+1.96*stddev_pop(yhat) AS yhat_upper FROM forecast GROUP BY 1,2""", dbl="yhat_media yhat_std yhat_lower yhat_upper")
def _(v: Views):
    return ensemble.spread(v.forecast)


_FC = "yhat_ensemble yhat_std yhat_lower yhat_upper yhat_media yhat_media_dow yhat_media_movil yhat_ultimo"


@query("forecast_table", "SELECT * FROM fc", dbl=_FC)
def _(v: Views):
    return v.fc


@query("interval_width", "SELECT *, yhat_upper-yhat_lower AS ancho FROM fc", dbl=_FC + " ancho")
def _(v: Views):
    return ensemble.interval_width(v.fc)


@query("model_forecast_mean", "SELECT serie, modelo, avg(yhat) AS media FROM forecast GROUP BY 1,2", dbl="media")
def _(v: Views):
    return ensemble.model_means(v.fc, SIMPLE_MODELS)


@query("overlap_check", """SELECT f.serie, primer_pronostico, ultimo_historico, primer_pronostico>ultimo_historico AS valido FROM
  (SELECT serie, min(ds) AS primer_pronostico FROM fc GROUP BY 1) f JOIN (SELECT serie, max(ds) AS ultimo_historico FROM daily GROUP BY 1) d USING (serie)""")
def _(v: Views):
    return ensemble.no_overlap(v.fc, v.daily_table)


@query("rising_tail", """SELECT serie, max(ds) AS hasta, bool_and(CASE WHEN r<5 THEN up ELSE true END) AND count(*)=5 AS creciente FROM (SELECT serie, ds,
  row_number() OVER (PARTITION BY serie ORDER BY ds DESC) r, yhat_ensemble > lag(yhat_ensemble) OVER (PARTITION BY serie ORDER BY ds) up FROM fc) WHERE r<=5 GROUP BY 1""")
def _(v: Views):
    return alerts.rising_tail(v.fc)


_AL = "valor_predicho umbral incertidumbre confianza"


@query("demand_alerts", "SELECT * FROM alerts", dbl=_AL)
def _(v: Views):
    return v.alerts


def _replay(v: Views):
    """The history itself, shaped like a forecast, so that every demand level occurs."""
    return v.daily_table.select("serie", "ds", F.col("y").cast("double").alias("yhat_ensemble"), F.lit(2.5).alias("yhat_std"))


_REPLAY = "(SELECT serie, ds, CAST(y AS DOUBLE) AS yhat_ensemble, CAST(2.5 AS DOUBLE) AS yhat_std FROM daily)"


def _alerts_over(src):
    from callstrata.plans.fixtures import alerts_sql
    return alerts_sql(src, "daily")


@query("demand_alerts_replay", _alerts_over(_REPLAY), dbl=_AL)
def _(v: Views):
    return alerts.demand_alerts(_replay(v), v.daily_table)


@query("uncertainty_alerts", f"SELECT * FROM ({_alerts_over(_REPLAY)}) WHERE tipo='ALTA_INCERTIDUMBRE'", dbl=_AL)
def _(v: Views):
    return alerts.demand_alerts(_replay(v), v.daily_table).where("tipo = 'ALTA_INCERTIDUMBRE'")


@query("monday_alerts", f"SELECT * FROM ({_alerts_over(_REPLAY)}) WHERE tipo='LUNES_ALTO'", dbl=_AL)
def _(v: Views):
    return alerts.demand_alerts(_replay(v), v.daily_table).where("tipo = 'LUNES_ALTO'")


@query("sort_alerts", """SELECT *, CASE severidad WHEN 'CRITICA' THEN 0 WHEN 'ALTA' THEN 1 WHEN 'MEDIA' THEN 2 WHEN 'BAJA' THEN 3 ELSE 4 END AS orden FROM alerts
  ORDER BY orden, fecha, serie, tipo""", dbl=_AL)
def _(v: Views):
    return alerts.sort_alerts(v.alerts)


@query("forecast_summary", """SELECT f.serie, avg(yhat_ensemble) AS media, max(yhat_ensemble) AS maximo, min(yhat_ensemble) AS minimo, stddev_samp(yhat_ensemble) AS desviacion,
  sum(yhat_ensemble) AS total, first(strftime(ds,'%A %Y-%m-%d') ORDER BY yhat_ensemble DESC, ds) AS dia_pico,
  any_value(coalesce(a.c,0)) AS criticas, any_value(coalesce(a.h,0)) AS altas FROM fc f LEFT JOIN (SELECT serie, count(*) FILTER (WHERE severidad='CRITICA') c,
  count(*) FILTER (WHERE severidad='ALTA') h FROM alerts GROUP BY 1) a USING (serie) GROUP BY 1""", dbl="media maximo minimo desviacion total")
def _(v: Views):
    return ensemble.forecast_summary(v.fc, v.alerts)


# --- scores and reports ------------------------------------------------------------------------

def _perf(v: Views):
    return scoring.performance(v.weights, v.fc, v.alerts)


@query("performance_score", "SELECT * FROM perf", dbl="mae_ensemble score score_general")
def _(v: Views):
    return _perf(v)


_BAD = "(SELECT * REPLACE (mae_ensemble*40 AS mae_ensemble, 1 AS modelos_activos, 33.0 AS score_general, 'CRITICO' AS estado, 7 AS alertas_criticas) FROM perf)"


def _bad_perf(v: Views):
    """The same results at forty times the error, so that every rule speaks."""
    return _perf(v).withColumns({"mae_ensemble": F.col("mae_ensemble") * 40, "modelos_activos": F.lit(1).cast("long"),
                                 "score_general": F.lit(33.0), "estado": F.lit("CRITICO"), "alertas_criticas": F.lit(7).cast("long")})


def _sys_sql(perf: str) -> str:
    last = "(SELECT score FROM runs ORDER BY run_ts DESC, serie LIMIT 1)"
    sg = f"(SELECT max(score_general) FROM {perf})"
    st = f"(SELECT max(estado) FROM {perf})"
    return f"""SELECT 'PERFORMANCE_CRITICA' AS tipo, 'CRITICA' AS severidad, 'Modelos '||serie AS componente,
      'MAE crítico de '||printf('%.2f',mae_ensemble)||' en '||serie||' (umbral: 25.0)' AS mensaje, 'Revisar inmediatamente calidad de datos y modelos' AS accion
      FROM {perf} WHERE mae_ensemble>25
    UNION ALL SELECT 'MODELOS_INSUFICIENTES','ALTA','Ensemble '||serie, 'Solo '||modelos_activos||' modelos activos en '||serie, 'Verificar entrenamiento de modelos adicionales'
      FROM {perf} WHERE modelos_activos<2
    UNION ALL SELECT 'MULTIPLES_ALERTAS_CRITICAS','CRITICA','Predicciones '||serie, alertas_criticas||' alertas críticas en predicciones de '||serie,
      'Revisar configuración de umbrales y capacidad operativa' FROM {perf} WHERE alertas_criticas>5
    UNION ALL SELECT 'DEGRADACION_PERFORMANCE','ALTA','Sistema General', printf('Degradación de %.1f%% en performance general', d),
      'Investigar causas de degradación y reentrenar modelos' FROM (SELECT ({last}-{sg})/{last}*100 AS d) WHERE d>20
    UNION ALL SELECT 'ESTADO_SISTEMA', CASE WHEN e='CRITICO' THEN 'CRITICA' ELSE 'ALTA' END, 'Sistema', 'Sistema en estado '||e, 'Revisión completa del sistema requerida'
      FROM (SELECT {st} AS e) WHERE e IN ('CRITICO','REQUIERE_ATENCION')"""


@query("system_alerts", _sys_sql(_BAD))
def _(v: Views):
    return scoring.system_alerts(_bad_perf(v), v.runs)


@query("system_alerts_normal", _sys_sql("perf"))
def _(v: Views):
    return scoring.system_alerts(_perf(v), v.runs)


@query("system_mae_mean", "SELECT coalesce(avg(mae_ensemble) FILTER (WHERE mae_ensemble>0),0) AS mae_promedio FROM perf", dbl="mae_promedio")
def _(v: Views):
    return scoring.system_mae_mean(_perf(v))


def _exec_sql(perf: str) -> str:
    return f"""SELECT 'BAJA' AS prioridad, 'OPERACIONES' AS area, 'Mantener Excelencia Operativa' AS titulo,
      'Sistema funcionando óptimamente. Mantener rutinas de monitoreo.' AS descripcion, 'MANTENIMIENTO' AS impacto_negocio FROM (SELECT max(estado) e FROM {perf}) WHERE e='EXCELENTE'
    UNION ALL SELECT 'CRITICA','TECNOLOGIA','Intervención Inmediata Requerida','Performance por debajo de estándares mínimos. Requiere revisión completa.','ALTO_RIESGO'
      FROM (SELECT max(estado) e FROM {perf}) WHERE e='CRITICO'
    UNION ALL SELECT 'ALTA','CALL_CENTER','Mejorar Predicciones '||serie, printf('MAE de %.1f en ', mae_ensemble)||serie||' requiere optimización','EFICIENCIA_OPERATIVA'
      FROM {perf} WHERE mae_ensemble>20"""


@query("exec_recommendations", _exec_sql(_BAD))
def _(v: Views):
    return scoring.exec_recommendations(_bad_perf(v))


@query("exec_recommendations_normal", _exec_sql("perf"))
def _(v: Views):
    return scoring.exec_recommendations(_perf(v))


@query("technical_diagnostics", """SELECT *, completitud::INT*25.0+consistencia::INT*25.0+valores_validos::INT*25.0+intervalos_consistentes::INT*25.0 AS score_calidad,
  CASE WHEN peso_maximo>0.7 THEN 'DESBALANCEADO' WHEN peso_maximo>0.5 THEN 'MODERADAMENTE_BALANCEADO' ELSE 'BIEN_BALANCEADO' END AS balance,
  CASE WHEN peso_maximo>0.7 THEN 30 WHEN peso_maximo>0.5 THEN 70 ELSE 90 END AS balance_score,
  CASE WHEN variabilidad<0.2 THEN 'ESTABLE' WHEN variabilidad<0.5 THEN 'MODERADAMENTE_ESTABLE' ELSE 'INESTABLE' END AS estabilidad,
  CASE WHEN variabilidad<0.2 THEN 90 WHEN variabilidad<0.5 THEN 70 ELSE 30 END AS estabilidad_score,
  CASE WHEN completitud::INT+consistencia::INT+valores_validos::INT+intervalos_consistentes::INT>=3 THEN 'BUENA'
   WHEN completitud::INT+consistencia::INT+valores_validos::INT+intervalos_consistentes::INT>=2 THEN 'REGULAR' ELSE 'MALA' END AS calidad,
  peso_maximo>0.6 AS recomienda_balance, modelos<3 AS recomienda_diversidad FROM
  (SELECT serie, max(peso) AS peso_maximo, count(*) AS modelos, stddev_pop(mae)/avg(mae) AS variabilidad FROM weights GROUP BY 1) w JOIN
  (SELECT serie, count(*)>=20 AS completitud, stddev_samp(yhat_ensemble)/avg(yhat_ensemble)<1 AS consistencia, bool_and(yhat_ensemble>=0) AS valores_validos,
   bool_and(yhat_upper>yhat_lower) AS intervalos_consistentes FROM fc GROUP BY 1) q USING (serie)""", dbl="peso_maximo variabilidad score_calidad")
def _(v: Views):
    return scoring.technical_diagnostics(v.weights, v.fc)


@query("business_impact", """SELECT max(score_general) AS score_general, CASE WHEN max(score_general)>=80 THEN 15000 WHEN max(score_general)>=60 THEN 8000 ELSE 0 END AS ahorro_mensual_usd,
  CASE WHEN max(score_general)>=80 THEN 15 WHEN max(score_general)>=60 THEN 8 ELSE 0 END AS mejora_satisfaccion_pct,
  CASE WHEN max(score_general)>=80 THEN 25 WHEN max(score_general)>=60 THEN 15 ELSE 0 END AS reduccion_overtime_pct,
  CASE WHEN max(score_general)>=80 THEN 15000 WHEN max(score_general)>=60 THEN 8000 ELSE 0 END*12/75000.0*100 AS roi_anual_pct FROM perf""", dbl="score_general roi_anual_pct")
def _(v: Views):
    return scoring.business_impact(_perf(v))


@query("baseline_improvement", """SELECT m AS mae_promedio, greatest(0.0,(32.81-m)/32.81*100) AS mejora_mae_pct, 32.81 AS baseline_mae, m<=10 AS objetivo_alcanzado
  FROM (SELECT avg(mae_ensemble) AS m FROM perf)""", dbl="mae_promedio mejora_mae_pct baseline_mae")
def _(v: Views):
    return scoring.baseline_improvement(_perf(v))


@query("weekly_validation", """SELECT serie, mae_minimo, problema, CASE WHEN count(problema) OVER ()>2 THEN 'CRITICO' WHEN count(problema) OVER ()>0 THEN 'ATENCION' ELSE 'OK' END AS estado
  FROM (SELECT t.serie, mae_minimo, CASE WHEN mae_minimo IS NULL THEN 'Sin resultados para '||t.serie WHEN mae_minimo>20 THEN 'Performance baja en '||t.serie END AS problema
  FROM (VALUES ('in'),('out'),('chat')) t(serie) LEFT JOIN (SELECT serie, min(mae) AS mae_minimo FROM metrics GROUP BY 1) USING (serie))""", dbl="mae_minimo")
def _(v: Views):
    return scoring.weekly_validation(v.metrics, ["in", "out", "chat"])


@query("run_series", "SELECT * FROM runs", dbl="score mae")
def _(v: Views):
    return v.runs


@query("degradation", """SELECT *, coalesce(degradacion_pct>20,false) AS alerta FROM (SELECT *, CASE WHEN previo>0 THEN (previo-score)/previo*100 END AS degradacion_pct FROM
  (SELECT *, lag(score) OVER (PARTITION BY serie ORDER BY run_ts) AS previo FROM runs))""", dbl="score mae previo degradacion_pct")
def _(v: Views):
    return scoring.degradation(v.runs)


_WK = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY serie ORDER BY run_ts DESC) r FROM runs) WHERE r<=7)"


@query("weekly_report", f"""SELECT *, score_promedio>=80 AS cumple_score, coalesce(mae_promedio<=10,false) AS cumple_mae FROM (SELECT serie, count(*) AS corridas,
  avg(score) AS score_promedio, avg(mae) FILTER (WHERE mae>0) AS mae_promedio, max_by(score,run_ts)-min_by(score,run_ts) AS mejora_score,
  CASE WHEN count(*) FILTER (WHERE mae>0)>=2 THEN stddev_pop(mae) FILTER (WHERE mae>0) ELSE 0 END AS estabilidad_mae FROM {_WK} GROUP BY 1)""",
       dbl="score_promedio mae_promedio mejora_score estabilidad_mae")
def _(v: Views):
    return scoring.weekly_report(v.runs)


@query("weekly_recommendations", f"""SELECT serie, 'TENDENCIA_NEGATIVA' AS tipo, 'Performance descendente durante la semana' AS descripcion,
  'Investigar causas de degradación y planificar mejoras' AS accion FROM {_WK} GROUP BY 1 HAVING count(*)>=2 AND max_by(score,run_ts)<min_by(score,run_ts)
  UNION ALL SELECT DISTINCT serie, 'ESTABILIDAD', e||' errores recientes detectados', 'Revisar logs y fortalecer monitoreo preventivo' FROM runs,
    (SELECT count(*) AS e FROM sessions, (SELECT max(run_ts) AS t FROM runs) WHERE status='failed' AND created_at <= t AND created_at > t - INTERVAL 7 DAY) WHERE e > 0""")
def _(v: Views):
    return scoring.weekly_recommendations(v.runs, scoring.recent_errors(v.runs, v.sessions.where("status = 'failed'"), "created_at"))


@query("run_freshness", f"""SELECT *, CASE WHEN sum(problema::INT) OVER ()=0 THEN 'OK' WHEN sum(problema::INT) OVER ()<=2 THEN 'DEGRADADO' ELSE 'CRITICO' END AS estado FROM
  (SELECT serie, ultima, horas, horas>36 AS problema FROM (SELECT serie, max(run_ts) AS ultima, date_diff('second', max(run_ts), TIMESTAMP '{AS_OF_LONG}')/3600.0 AS horas FROM runs GROUP BY 1))""",
       dbl="horas")
def _(v: Views):
    return scoring.run_freshness(v.runs, AS_OF_LONG)


@query("next_retrain_date", """SELECT serie, hoy, CAST(hoy + CAST(7-isodow(hoy)%7 AS INTEGER) AS DATE) AS fecha_programada, CAST(7-isodow(hoy)%7 AS INTEGER) AS dias_restantes FROM
  (SELECT serie, CAST(max(run_ts) AS DATE) AS hoy FROM runs GROUP BY 1)""")
def _(v: Views):
    return scoring.next_retrain(v.runs)


@query("result_overview", """SELECT 'registros' AS elemento, CAST(sum(y) AS BIGINT) AS n FROM daily UNION ALL SELECT 'modelos', count(*) FROM weights
  UNION ALL SELECT 'predicciones', count(*) FROM fc""")
def _(v: Views):
    return scoring.result_overview(v.weights, v.fc, v.daily_table)


# --- recommendations over the audit ------------------------------------------------------------

def _audit_metrics(v: Views):
    """The four figures the rules look at, as one row of independent subqueries."""
    days = audit.business_days(v.calls)
    outliers = audit.iqr_outliers(days).agg(rows())
    hours = audit.seasonal_profile(v.calls).where("dimension = 'hora'").agg(F.stddev_samp("n") / F.avg("n"))
    score = audit.completeness(v.calls).agg(F.max("score_promedio"))
    return audit.daily_stats(days).select(
        "coef_variacion", score.scalar().alias("score_promedio"), hours.scalar().alias("variabilidad_horaria"),
        outliers.scalar().alias("atipicos"))


_D = "SELECT CAST(FECHA AS DATE) AS ds, count(*) AS y FROM calls WHERE isodow(FECHA)<=5 GROUP BY 1"
_MX = f"""SELECT (SELECT avg(s) FROM (SELECT 100-(count(*)-count(COLUMNS(*)))*100.0/count(*) FROM calls) x(a,b,c,d,e,f,g,h,i), LATERAL (SELECT unnest([a,b,c,d,e,f,g,h,i]) AS s)) AS sp,
  (SELECT stddev_samp(y)/avg(y) FROM ({_D})) AS cv, (SELECT count(*) FROM ({_D}), (SELECT quantile_cont(y,0.25) a, quantile_cont(y,0.75) b FROM ({_D}))
   WHERE y>b+1.5*(b-a) OR y<a-1.5*(b-a)) AS ou, (SELECT stddev_samp(n)/avg(n) FROM (SELECT hour(FECHA), count(*) n FROM calls WHERE isodow(FECHA)<=5 GROUP BY 1)) AS vh"""


def _recs_sql(scale: str) -> str:
    return f"""WITH m AS (SELECT sp{scale} AS sp, cv*1.0 AS cv, ou, vh FROM ({_MX})), x AS (SELECT sp*0.5 AS sp, cv+0.5 AS cv, ou+6 AS ou, vh+0.8 AS vh FROM m)
      SELECT 'CALIDAD_DATOS' AS tipo, 'ALTA' AS prioridad, printf('Calidad de datos baja (%.1f/100)', sp) AS problema,
        'Implementar validación de datos en origen y limpieza automatizada' AS solucion FROM x WHERE sp<80
      UNION ALL SELECT 'VARIABILIDAD','ALTA',printf('Alta variabilidad diaria (%.3f)', cv),'Usar modelos que manejen bien la variabilidad (ARIMA, ensemble methods)' FROM x WHERE cv>0.5
      UNION ALL SELECT 'OUTLIERS','MEDIA','Múltiples días con volúmenes atípicos','Implementar detección y tratamiento automático de outliers' FROM x WHERE ou>5
      UNION ALL SELECT 'ESTACIONALIDAD','ALTA','Fuerte patrón horario no capturado','Agregar regresores horarios y usar modelos con estacionalidad múltiple' FROM x WHERE vh>0.8"""


@query("audit_metrics", f"SELECT cv AS coef_variacion, sp AS score_promedio, vh AS variabilidad_horaria, ou AS atipicos FROM ({_MX})",
       dbl="coef_variacion score_promedio variabilidad_horaria")
def _(v: Views):
    return _audit_metrics(v).select("coef_variacion", "score_promedio", "variabilidad_horaria", "atipicos")


@query("audit_recommendations", _recs_sql(""))
def _(v: Views):
    """Each figure is moved past its threshold by a constant, so that every rule speaks."""
    m = _audit_metrics(v)
    return alerts.audit_recommendations(m.select(
        (F.col("score_promedio") * 0.5).alias("score_promedio"), (F.col("coef_variacion") + 0.5).alias("coef_variacion"),
        (F.col("atipicos") + 6).alias("atipicos"), (F.col("variabilidad_horaria") + 0.8).alias("variabilidad_horaria")))


def _seg_recs_sql(src: str) -> str:
    return f"""WITH k AS (SELECT tipo_llamada, count(*) n, sum(confianza_segmentacion) c FROM {src} GROUP BY 1),
      m AS (SELECT coalesce(sum(n) FILTER (WHERE tipo_llamada='INDETERMINADA'),0)*100.0/sum(n) AS ind, coalesce(sum(n) FILTER (WHERE tipo_llamada='ENTRANTE'),0)
        /greatest(1, coalesce(sum(n) FILTER (WHERE tipo_llamada='SALIENTE'),1)) AS ra, count(*) AS t, sum(c)/sum(n) AS co FROM k)
      SELECT 'SEGMENTACION' AS tipo, 'ALTA' AS prioridad, printf('%.1f%% de llamadas sin clasificar', ind) AS problema,
        'Revisar campos adicionales de origen para mejorar clasificación' AS solucion FROM m WHERE ind>20
      UNION ALL SELECT 'BALANCE','MEDIA',printf('Desbalance entre tipos: ratio %.1f', ra),'Crear modelos separados para cada tipo de llamada' FROM m WHERE t>=2 AND (ra>5 OR ra<0.2)
      UNION ALL SELECT 'CONFIANZA','ALTA',printf('Confianza de segmentación baja (%.2f)', co),'Validar manualmente una muestra y ajustar reglas de clasificación' FROM m WHERE co<0.7"""


@query("segment_recommendations", _seg_recs_sql(
    """(SELECT CASE WHEN STATUS<>'SIGNUP' AND SENTIDO='out' THEN 'INDETERMINADA' WHEN STATUS='SIGNUP' AND ATENDIDA='Si' THEN 'ENTRANTE' ELSE tipo_llamada END AS tipo_llamada,
    confianza_segmentacion*0.7 AS confianza_segmentacion FROM seg)"""))
def _(v: Views):
    """A log bent towards undetermined and incoming calls with low confidence."""
    bent = v.seg.select(
        F.when((F.col("STATUS") != "SIGNUP") & (F.col("SENTIDO") == "out"), "INDETERMINADA").when(
            (F.col("STATUS") == "SIGNUP") & (F.col("ATENDIDA") == "Si"), "ENTRANTE").otherwise(F.col("tipo_llamada")).alias("tipo_llamada"),
        (F.col("confianza_segmentacion") * 0.7).alias("confianza_segmentacion"))
    return alerts.segment_recommendations(bent)


@query("segment_recommendations_normal", _seg_recs_sql("seg"))
def _(v: Views):
    return alerts.segment_recommendations(v.seg)


@query("data_validation_alerts", """WITH r AS (SELECT call_id, try_strptime(FECHA_TXT,'%d-%m-%Y %H:%M:%S') AS FECHA FROM calls_raw)
  SELECT * FROM (SELECT 'fechas_invalidas' AS hallazgo, count(*)-count(FECHA) AS n FROM r
  UNION ALL SELECT 'sin_datos', CASE WHEN count(FECHA)=0 THEN 1 ELSE 0 END FROM r
  UNION ALL SELECT 'fechas_futuras', count(*) FILTER (WHERE CAST(FECHA AS DATE)>DATE '2024-01-20') FROM r
  UNION ALL SELECT 'filas_desordenadas', count(*) FILTER (WHERE p>FECHA) FROM (SELECT FECHA, lag(FECHA) OVER (ORDER BY call_id) AS p FROM r)
  UNION ALL SELECT 'brechas', count(*) FROM (SELECT ds, lag(ds) OVER (PARTITION BY serie ORDER BY ds) p FROM sparse) WHERE ds-p>7) WHERE n>0""")
def _(v: Views):
    from callstrata.functions.dates import parse_call_time
    raw = v.calls_raw.withColumn("FECHA", parse_call_time(F.col("FECHA_TXT")))
    return alerts.validation_alerts(raw, v.sparse, "2024-01-20")
