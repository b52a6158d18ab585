"""Audit, segmentation and calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callstrata.operators import alerts, audit, calendar, ensemble, roles, segment
from callstrata.plans.fixtures import AS_OF_CALLS, Views
from callstrata.plans.registry import query


def rows():
    return F.count(F.lit(1))


@query("daily_calls", "SELECT * FROM sparse_calls", dbl="hora_promedio")
def _(v: Views):
    return segment.daily_calls(v.calls)


@query("calendar_complete", "SELECT * FROM daily", dbl="hora_promedio")
def _(v: Views):
    return v.daily


@query("calendar_complete_weekdays", "SELECT * FROM daily WHERE isodow(ds)<=5", dbl="hora_promedio")
def _(v: Views):
    return calendar.complete_calendar(v.sparse, weekdays_only=True)


@query("segmentation_totals", """SELECT serie, CAST(sum(y) AS BIGINT) AS total, avg(y) AS promedio_diario, count(*) AS dias,
  CAST(sum(atendidas) AS BIGINT) AS atendidas, min(ds) AS desde, max(ds) AS hasta FROM days_calls GROUP BY 1""", dbl="promedio_diario")
def _(v: Views):
    return segment.segmentation_totals(v.days_calls)


@query("audit_summary", """SELECT count(*) AS total, min(FECHA) AS desde, max(FECHA) AS hasta, count(DISTINCT CAST(FECHA AS DATE)) AS dias,
  count(*) FILTER (WHERE SENTIDO='in') AS entrantes, count(*) FILTER (WHERE SENTIDO='out') AS salientes,
  count(*) FILTER (WHERE ATENDIDA='Si') AS atendidas FROM calls""")
def _(v: Views):
    return audit.audit_summary(v.calls)


@query("temporal_profile", """WITH d AS (SELECT CAST(FECHA AS DATE) AS ds FROM calls_long)
  SELECT 'fecha_minima' AS metrica, NULL AS clave, CAST(min(ds) AS VARCHAR) AS valor FROM d
  UNION ALL SELECT 'fecha_maxima', NULL, CAST(max(ds) AS VARCHAR) FROM d
  UNION ALL SELECT 'dias_totales', NULL, CAST(date_diff('day', min(ds), max(ds)) AS VARCHAR) FROM d
  UNION ALL SELECT 'dias_unicos', NULL, CAST(count(DISTINCT ds) AS VARCHAR) FROM d
  UNION ALL SELECT 'fechas_nulas', NULL, CAST(count(*) FILTER (WHERE ds IS NULL) AS VARCHAR) FROM d
  UNION ALL SELECT 'dia_semana', dayname(ds), CAST(count(*) AS VARCHAR) FROM d GROUP BY 2
  UNION ALL SELECT 'mes', monthname(ds), CAST(count(*) AS VARCHAR) FROM d GROUP BY 2""")
def _(v: Views):
    return audit.temporal_profile(v.calls_long)


@query("value_counts", """SELECT 'SENTIDO' AS columna, SENTIDO AS valor, count(*) AS n FROM calls GROUP BY 2
  UNION ALL SELECT 'ATENDIDA', ATENDIDA, count(*) FROM calls GROUP BY 2 UNION ALL SELECT 'STATUS', STATUS, count(*) FROM calls GROUP BY 2""")
def _(v: Views):
    return audit.value_counts_all(v.calls)


@query("phone_prefix_top", """SELECT substring(TELEFONO,1,11) AS prefijo, count(*) AS n FROM calls_long WHERE TELEFONO IS NOT NULL GROUP BY 1
  ORDER BY n DESC, prefijo LIMIT 10""")
def _(v: Views):
    return audit.phone_prefixes(v.calls_long, width=11)


@query("phone_prefix3_top", """SELECT substring(TELEFONO,1,3) AS prefijo, count(*) AS n FROM calls WHERE TELEFONO IS NOT NULL GROUP BY 1
  ORDER BY n DESC, prefijo LIMIT 10""")
def _(v: Views):
    return audit.phone_prefixes(v.calls)


@query("phone_length_profile", """WITH l AS (SELECT length(nullif(regexp_extract(TELEFONO,'(\\d+)',1),'')) AS longitud FROM calls),
  c AS (SELECT CAST(longitud AS INTEGER) AS longitud, count(*) AS n FROM l WHERE longitud IS NOT NULL GROUP BY 1)
  SELECT longitud, n, (SELECT avg(longitud) FROM l) AS promedio, (SELECT longitud FROM c ORDER BY n DESC, longitud LIMIT 1) AS moda
  FROM c ORDER BY n DESC, longitud LIMIT 10""", dbl="promedio")
def _(v: Views):
    return audit.phone_lengths(v.calls)


_BD = "SELECT CAST(FECHA AS DATE) AS ds, count(*) AS y FROM calls_long WHERE isodow(FECHA)<=5 GROUP BY 1"


@query("daily_volume_stats", f"""SELECT avg(y) AS promedio, median(y) AS mediana, stddev_samp(y) AS desviacion,
  stddev_samp(y)/nullif(avg(y),0) AS coef_variacion, first(ds ORDER BY y DESC, ds) AS dia_max, max(y) AS max,
  first(ds ORDER BY y, ds) AS dia_min, min(y) AS min, count(*) AS dias, count(*) FILTER (WHERE y=0) AS dias_sin_llamadas FROM ({_BD})""",
       dbl="promedio mediana desviacion coef_variacion")
def _(v: Views):
    return audit.daily_stats(audit.business_days(v.calls_long))


@query("iqr_outliers", """WITH q AS (SELECT serie, quantile_cont(y,0.25) a, quantile_cont(y,0.75) b FROM sparse GROUP BY 1),
  j AS (SELECT serie, ds, y, a-1.5*(b-a) AS limite_inferior, b+1.5*(b-a) AS limite_superior FROM sparse JOIN q USING (serie))
  SELECT *, CASE WHEN y>limite_superior THEN 'superior' ELSE 'inferior' END AS lado FROM j WHERE y>limite_superior OR y<limite_inferior""",
       dbl="limite_inferior limite_superior")
def _(v: Views):
    return audit.iqr_outliers(v.sparse.select("serie", "ds", "y"), "serie")


_SEASON = """SELECT 'hora' AS dimension, CAST(hour(FECHA) AS INTEGER) AS clave, count(*) AS n FROM calls WHERE isodow(FECHA)<=5 GROUP BY 2
  UNION ALL SELECT 'dia_semana', CAST(isodow(FECHA)-1 AS INTEGER), count(*) FROM calls WHERE isodow(FECHA)<=5 GROUP BY 2
  UNION ALL SELECT 'dia_mes', CAST(day(FECHA) AS INTEGER), count(*) FROM calls WHERE isodow(FECHA)<=5 GROUP BY 2
  UNION ALL SELECT 'semana', CAST(weekofyear(FECHA) AS INTEGER), count(*) FROM calls WHERE isodow(FECHA)<=5 GROUP BY 2"""


@query("seasonal_profile", _SEASON)
def _(v: Views):
    return audit.seasonal_profile(v.calls)


@query("peak_valley", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, clave) AS p,
    row_number() OVER (PARTITION BY dimension ORDER BY n, clave) AS q,
    stddev_samp(n) OVER (PARTITION BY dimension)/avg(n) OVER (PARTITION BY dimension) AS variabilidad
    FROM ({_SEASON}) WHERE dimension IN ('hora','dia_semana'))
  SELECT dimension, 'pico' AS clase, CAST(p AS INTEGER) AS puesto, clave, n, variabilidad FROM r WHERE p<=3
  UNION ALL SELECT dimension, 'valle', CAST(q AS INTEGER), clave, n, variabilidad FROM r WHERE q<=3 AND dimension='hora'""", dbl="variabilidad")
def _(v: Views):
    return audit.peak_valley(audit.seasonal_profile(v.calls))


_CALL_COLS = ["call_id", "FECHA", "TELEFONO", "SENTIDO", "ATENDIDA", "STATUS", "DURACION", "USUARIO", "CARGO"]
_NULLS = " UNION ALL ".join(f"SELECT '{c}' AS columna, count(*)-count({c}) AS nulos, count(*) AS t FROM calls" for c in _CALL_COLS)


@query("completeness", f"""SELECT columna, nulos, nulos*100.0/t AS pct_nulos, 100-nulos*100.0/t AS score,
  avg(100-nulos*100.0/t) OVER () AS score_promedio FROM ({_NULLS})""", dbl="pct_nulos score score_promedio")
def _(v: Views):
    return audit.completeness(v.calls)


@query("duplicate_count", """SELECT CAST(count(*)-(SELECT count(*) FROM (SELECT DISTINCT USUARIO, SENTIDO, ATENDIDA, CAST(FECHA AS DATE) FROM calls)) AS BIGINT)
  AS duplicados, count(*) AS filas FROM calls""")
def _(v: Views):
    return audit.duplicate_count(v.calls.select("USUARIO", "SENTIDO", "ATENDIDA", F.to_date("FECHA").alias("ds")))


def _nq(c, src):
    return (f"SELECT '{c}' AS columna, count(*) FILTER (WHERE {c}<0) AS negativos, count(*) FILTER (WHERE {c}=0) AS ceros, "
            f"count(*) FILTER (WHERE abs(({c}-m)/nullif(s,0))>3) AS atipicos FROM {src}, "
            f"(SELECT avg({c}) m, stddev_samp({c}) s FROM {src})")


@query("numeric_quality", _nq("call_id", "calls") + " UNION ALL " + _nq("DURACION", "calls"))
def _(v: Views):
    return audit.numeric_quality(v.calls, ["call_id", "DURACION"])


@query("upload_overview", f"SELECT max(t) AS filas, {len(_CALL_COLS)} AS columnas, CAST(sum(nulos) AS BIGINT) AS nulos FROM ({_NULLS})")
def _(v: Views):
    return audit.overview(v.calls)


@query("hourly_profile", """WITH h AS (SELECT CAST(hour(FECHA) AS INTEGER) AS hora, count(*) AS n FROM calls GROUP BY 1)
  SELECT first(hora ORDER BY n DESC, hora) AS hora_pico, max(n) AS llamadas_pico, first(hora ORDER BY n, hora) AS hora_valle,
  min(n) AS llamadas_valle, sum(n) FILTER (WHERE hora BETWEEN 8 AND 17)*100.0/sum(n) AS pct_horario_laboral FROM h""",
       dbl="pct_horario_laboral")
def _(v: Views):
    return segment.hourly_profile(v.calls)


@query("calls_per_hour", "SELECT CAST(hour(FECHA) AS INTEGER) AS hora, count(*) AS n FROM calls GROUP BY 1")
def _(v: Views):
    return segment.calls_per_hour(v.calls)


@query("segment_rules", "SELECT call_id, tipo_llamada, confianza_segmentacion FROM seg", dbl="confianza_segmentacion")
def _(v: Views):
    return v.seg.select("call_id", "tipo_llamada", "confianza_segmentacion")


@query("segment_summary", """SELECT s.tipo_llamada, o.*, count(*) AS llamadas, count(*)*100.0/(SELECT count(*) FROM seg) AS pct FROM seg s,
  (SELECT avg(confianza_segmentacion) FILTER (WHERE tipo_llamada<>'INDETERMINADA') AS confianza_promedio,
    median(confianza_segmentacion) AS confianza_mediana, count(*) FILTER (WHERE confianza_segmentacion>0.8) AS alta_confianza,
    count(*) FILTER (WHERE confianza_segmentacion<0.5) AS baja_confianza FROM seg) o GROUP BY ALL""",
       dbl="confianza_promedio confianza_mediana pct")
def _(v: Views):
    return segment.segment_summary(v.seg)


@query("segment_hours", """SELECT tipo_llamada, CAST(hora AS INTEGER) AS hora, count(*) AS n FROM seg
  WHERE tipo_llamada IN ('ENTRANTE','SALIENTE') GROUP BY 1,2""")
def _(v: Views):
    return segment.segment_hours(v.seg)


@query("daily_prophet", """SELECT tipo_llamada AS serie, CAST(FECHA AS DATE) AS ds, count(*) AS y, avg(confianza_segmentacion) AS confianza_promedio,
  CAST(isodow(CAST(FECHA AS DATE)) AS INTEGER) AS dia_semana, CAST(day(CAST(FECHA AS DATE))<=5 AS INTEGER) AS es_inicio_mes,
  CAST((day(CAST(FECHA AS DATE))-1)//7+1 AS INTEGER) AS semana_mes FROM seg WHERE isodow(FECHA)<=5 GROUP BY ALL""", dbl="confianza_promedio")
def _(v: Views):
    return segment.daily_by_type(v.seg)


@query("daily_pivot_types", """SELECT CAST(FECHA AS DATE) AS ds, count(*) FILTER (WHERE tipo_llamada='ENTRANTE') AS ENTRANTE,
  count(*) FILTER (WHERE tipo_llamada='SALIENTE') AS SALIENTE, count(*) FILTER (WHERE tipo_llamada='INDETERMINADA') AS INDETERMINADA,
  count(*) AS total FROM seg GROUP BY 1""")
def _(v: Views):
    return segment.daily_pivot(v.seg)


@query("history_series", "SELECT CAST(FECHA AS DATE) AS ds, count(*) AS y FROM calls_long WHERE SENTIDO='in' GROUP BY 1")
def _(v: Views):
    return segment.history(v.calls_long, "in")


# --- holidays ----------------------------------------------------------------------------------

_FLAGS = "call_id, ds, es_feriado, feriado_descripcion, feriado_categoria"


@query("holiday_lookup", f"SELECT {_FLAGS} FROM marked")
def _(v: Views):
    return v.marked.select(*_FLAGS.split(", "))


@query("pre_post_holiday", "SELECT call_id, pre_feriado, post_feriado FROM marked")
def _(v: Views):
    return v.marked.select("call_id", "pre_feriado", "post_feriado")


@query("holiday_category", "SELECT fecha, descripcion, categoria FROM hol_long")
def _(v: Views):
    return v.hol_long.select("fecha", "descripcion", "categoria")


@query("long_weekend", "SELECT DISTINCT ds, fin_semana_largo FROM marked")
def _(v: Views):
    return v.marked.select("ds", "fin_semana_largo").distinct()


@query("day_type", "SELECT call_id, tipo_dia FROM marked")
def _(v: Views):
    return v.marked.select("call_id", "tipo_dia")


@query("day_type_national", "SELECT call_id, tipo_dia, feriado_descripcion FROM marked_calls")
def _(v: Views):
    return v.marked_calls.select("call_id", "tipo_dia", "feriado_descripcion")


@query("training_flags", """SELECT call_id, false AS excluir_de_entrenamiento, coalesce(SENTIDO='out',false) AND
  (es_feriado OR pre_feriado OR post_feriado) AS aplicar_filtro_feriados FROM marked""")
def _(v: Views):
    return calendar.training_flags(v.marked, "SENTIDO").select("call_id", "excluir_de_entrenamiento", "aplicar_filtro_feriados")


@query("training_flags_outgoing", """SELECT call_id, es_feriado OR pre_feriado OR post_feriado AS excluir_de_entrenamiento,
  es_feriado OR pre_feriado OR post_feriado AS aplicar_filtro_feriados FROM marked""")
def _(v: Views):
    return calendar.training_flags(v.marked, outgoing_only=True).select("call_id", "excluir_de_entrenamiento", "aplicar_filtro_feriados")


@query("day_type_counts", "SELECT tipo_dia, count(*) AS llamadas, count(*)*100.0/sum(count(*)) OVER () AS pct FROM marked GROUP BY 1", dbl="pct")
def _(v: Views):
    return roles.day_types(v.marked_counts)


@query("holiday_totals", """SELECT count(*) AS total, count(*) FILTER (WHERE es_feriado) AS n_feriado, count(*) FILTER (WHERE pre_feriado) AS n_pre,
  count(*) FILTER (WHERE post_feriado) AS n_post, count(*) FILTER (WHERE es_feriado)*100.0/count(*) AS pct_feriado,
  count(*) FILTER (WHERE pre_feriado)*100.0/count(*) AS pct_pre, count(*) FILTER (WHERE post_feriado)*100.0/count(*) AS pct_post FROM marked""",
       dbl="pct_feriado pct_pre pct_post")
def _(v: Views):
    return roles.holiday_totals(v.marked_counts)


@query("attendance_by_day_type", """SELECT tipo_dia, count(*) FILTER (WHERE ATENDIDA='Si') AS si, count(*) FILTER (WHERE ATENDIDA='No') AS "no",
  count(*) FILTER (WHERE ATENDIDA='Si')*100.0/nullif(count(*) FILTER (WHERE ATENDIDA IN ('Si','No')),0) AS tasa_atencion FROM marked GROUP BY 1""",
       dbl="tasa_atencion")
def _(v: Views):
    return roles.attendance_by_day_type(v.marked_counts)


@query("holiday_category_counts", "SELECT feriado_categoria, count(*) AS llamadas FROM marked WHERE es_feriado GROUP BY 1")
def _(v: Views):
    return roles.by_category(v.marked_counts)


_HOURS = ", ".join(f"count(*) FILTER (WHERE hour(FECHA)={h}) AS h{h:02d}" for h in range(24))


@query("holiday_hour_pivot", f"SELECT es_feriado, {_HOURS} FROM marked_calls GROUP BY 1")
def _(v: Views):
    return roles.holiday_hours(v.marked_hours)


_HM = """SELECT *, coalesce((promedio_feriado-promedio_normal)*100.0/nullif(promedio_normal,0),0) AS variacion_feriado_pct,
  coalesce((promedio_pre_feriado-promedio_normal)*100.0/nullif(promedio_normal,0),0) AS variacion_pre_feriado_pct FROM (SELECT count(*) AS total_llamadas,
  count(*) FILTER (WHERE es_feriado) AS llamadas_feriados,
  count(*) FILTER (WHERE tipo_dia='Día Laboral')/greatest(count(DISTINCT ds) FILTER (WHERE tipo_dia='Día Laboral'),1) AS promedio_normal,
  count(*) FILTER (WHERE es_feriado)/greatest(count(DISTINCT ds) FILTER (WHERE es_feriado),1) AS promedio_feriado,
  count(*) FILTER (WHERE pre_feriado)/greatest(count(DISTINCT ds) FILTER (WHERE pre_feriado),1) AS promedio_pre_feriado,
  count(*) FILTER (WHERE es_feriado)*100.0/count(*) AS pct_feriados FROM marked)"""


@query("holiday_metrics", _HM, dbl="promedio_normal promedio_feriado promedio_pre_feriado pct_feriados variacion_feriado_pct variacion_pre_feriado_pct")
def _(v: Views):
    return roles.holiday_metrics(v.marked_counts)


@query("holiday_impact_class", f"""SELECT variacion_feriado_pct, CASE WHEN variacion_feriado_pct>10 THEN 'mayor_demanda' WHEN variacion_feriado_pct<-10
  THEN 'menor_demanda' ELSE 'demanda_estable' END AS impacto FROM ({_HM})""", dbl="variacion_feriado_pct")
def _(v: Views):
    return roles.impact_class(roles.holiday_metrics(v.marked_counts))


@query("top_holidays", """SELECT ds, feriado_descripcion, count(*) AS llamadas FROM marked WHERE es_feriado GROUP BY 1,2 ORDER BY llamadas DESC, ds LIMIT 5""")
def _(v: Views):
    return roles.top_holidays(v.marked_counts)


_RHS = """SELECT CARGO, count(*) AS total_llamadas, count(*) FILTER (WHERE es_feriado) AS llamadas_feriados,
  count(*) FILTER (WHERE es_feriado)*100.0/count(*) AS porcentaje_feriados FROM marked GROUP BY 1"""


@query("holiday_share_by_role", """SELECT t.CARGO, t.n AS total_llamadas, coalesce(h.n,0) AS llamadas_feriados, coalesce(h.n,0)*100.0/t.n AS porcentaje_feriados
  FROM (SELECT CARGO, count(*) n FROM marked GROUP BY 1) t LEFT JOIN (SELECT CARGO, count(*) n FROM marked WHERE es_feriado GROUP BY 1) h USING (CARGO)""",
       dbl="porcentaje_feriados")
def _(v: Views):
    return roles.role_holiday_share(v.marked_counts)


_KIND = {"laboral": "tipo_dia='Día Laboral'", "fin_semana": "tipo_dia='Fin de Semana'", "fin_semana_largo": "tipo_dia='Fin de Semana Largo'",
         "pre": "tipo_dia='Pre-Feriado'", "post": "tipo_dia='Post-Feriado'", "feriado": "starts_with(tipo_dia,'Feriado')"}


@query("role_daytype_share", "SELECT CARGO, " + ", ".join(f"count(*) FILTER (WHERE {c})*100.0/count(*) AS {k}" for k, c in _KIND.items())
       + " FROM marked GROUP BY 1", dbl=" ".join(_KIND))
def _(v: Views):
    return roles.role_daytype(v.marked_counts)


@query("role_attendance", "SELECT CARGO, " + ", ".join(
    f"count(*) FILTER (WHERE {c} AND ATENDIDA='Si')*100.0/nullif(count(*) FILTER (WHERE {c}),0) AS tasa_{k}, count(*) FILTER (WHERE {c}) AS n_{k}"
    for k, c in _KIND.items()) + " FROM marked GROUP BY 1", dbl=" ".join(f"tasa_{k}" for k in _KIND))
def _(v: Views):
    return roles.role_attendance(v.marked_counts)


@query("role_extremes", f"""SELECT first(CARGO ORDER BY porcentaje_feriados DESC, CARGO) AS mas_afectado, max(porcentaje_feriados) AS pct_max,
  first(CARGO ORDER BY porcentaje_feriados, CARGO) AS menos_afectado, min(porcentaje_feriados) AS pct_min, count(*) AS cargos FROM ({_RHS})""",
       dbl="pct_max pct_min")
def _(v: Views):
    return roles.role_extremes(roles.role_holiday_share(v.marked_counts))


def _role_recs_sql() -> str:
    r = lambda c, t: f"CASE WHEN {c} THEN {t} END"
    busy, calm, some = "p>20", "p<5", "p>=5 AND p<=20"
    lead = "(contains(l,'supervisor') OR contains(l,'jefe'))"
    agent = f"(NOT {lead} AND (contains(l,'agente') OR contains(l,'call center')))"
    clerk = f"(NOT {lead} AND NOT {agent} AND contains(l,'secretaria'))"
    lines = [
        r(busy, "printf('Alto volumen en feriados (%.1f%%): Programar personal adicional', p)"),
        r(busy, "'Considerar incentivos especiales para feriados'"), r(busy, "'Monitorear de cerca la calidad de servicio'"),
        r(calm, "printf('Baja actividad en feriados (%.1f%%): Oportunidad para capacitación', p)"),
        r(calm, "'Ideal para mantenimiento de sistemas'"), r(calm, "'Programar entrenamientos especializados'"),
        r(some, "printf('Actividad moderada en feriados (%.1f%%): Mantener staff regular', p)"), r(some, "'Monitorear tendencias estacionales'"),
        r("n>med", "'Cargo de alto volumen: Priorizar en análisis'"), r("n>med", "'Implementar métricas específicas de performance'"),
        r(lead, "'Rol de liderazgo: Coordinar equipos en feriados'"), r(lead, "'Planificar horarios especiales'"),
        r(agent, "'Personal operativo: Evaluar rotación en feriados'"), r(agent, "'Considerar turnos flexibles'"),
        r(clerk, "'Soporte administrativo: Backup en feriados críticos'")]
    arr = f"list_filter([{', '.join(lines)}], lambda x: x IS NOT NULL)"
    return (f"SELECT CARGO, CAST(unnest(range(len(a))) AS INTEGER) AS orden, unnest(a) AS recomendacion FROM (SELECT CARGO, {arr} AS a FROM "
            f"(SELECT CARGO, porcentaje_feriados AS p, total_llamadas AS n, lower(CARGO) AS l, median(total_llamadas) OVER () AS med FROM ({_RHS})))")


@query("role_recommendations", _role_recs_sql())
def _(v: Views):
    return alerts.role_recommendations(roles.role_holiday_share(v.marked_counts))


@query("holiday_calendar", """WITH d AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS ds),
  k AS (SELECT ds, year(ds) AS anio, month(ds) AS mes, (day(ds)-1+isodow(date_trunc('month',ds))-1)//7 AS semana_mes FROM d)
  SELECT CAST(anio AS INTEGER) AS anio, CAST(mes AS INTEGER) AS mes, CAST(semana_mes AS INTEGER) AS semana_mes, count(*) AS dias,
  count(n.f) FILTER (WHERE n.es_feriado) AS feriados, CAST(coalesce(sum(c.n),0) AS BIGINT) AS llamadas
  FROM k LEFT JOIN near_long n ON k.ds=n.f LEFT JOIN (SELECT CAST(FECHA AS DATE) AS ds, count(*) n FROM calls_long GROUP BY 1) c ON c.ds=k.ds
  GROUP BY 1,2,3""")
def _(v: Views):
    years = v.calls_long.select(F.year("FECHA").alias("anio")).distinct()
    per_day = v.calls_long.groupBy(F.to_date("FECHA").alias("ds")).agg(rows().alias("n"))
    return calendar.holiday_calendar(years, v.hol_long).join(per_day, "ds", "left").groupBy(
        F.year("ds").alias("anio"), "mes", "semana_mes").agg(
        rows().alias("dias"), F.count_if("es_feriado").alias("feriados"), F.coalesce(F.sum("n"), F.lit(0)).alias("llamadas"))


# --- users -------------------------------------------------------------------------------------

@query("role_distribution", """SELECT CARGO, count(*) AS usuarios, count(*)*100.0/sum(count(*)) OVER () AS pct, count(*) OVER () AS cargos,
  CAST(row_number() OVER (ORDER BY count(*) DESC, CARGO) AS INTEGER) AS puesto FROM users GROUP BY 1""", dbl="pct")
def _(v: Views):
    return roles.role_distribution(v.users)


_BY_USER = """SELECT o.USUARIO, o.CARGO, coalesce(k.llamadas, 0) AS llamadas, coalesce(k.dias, 0) AS dias, k.llamadas/k.dias AS llamadas_por_dia,
  k.a*100.0/k.llamadas AS tasa_atencion, k.duracion_media FROM (SELECT USUARIO, min(CARGO) AS CARGO FROM users WHERE USUARIO IS NOT NULL GROUP BY 1) o
  FULL JOIN (SELECT p.USUARIO, count(*) AS llamadas, count(DISTINCT CAST(c.FECHA AS DATE)) AS dias, count(*) FILTER (WHERE c.ATENDIDA='Si') AS a,
    avg(c.DURACION) AS duracion_media FROM calls c LEFT JOIN (SELECT TELEFONO, min(USUARIO) AS USUARIO FROM users GROUP BY 1) p USING (TELEFONO) GROUP BY 1) k
  ON o.USUARIO = k.USUARIO"""


@query("calls_by_user", _BY_USER, dbl="llamadas_por_dia tasa_atencion duracion_media")
def _(v: Views):
    return roles.calls_by_user(v.calls, v.users)


@query("user_ranking", f"""SELECT * FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY CARGO ORDER BY llamadas DESC) AS INTEGER) AS puesto FROM ({_BY_USER}) WHERE USUARIO IS NOT NULL)
  WHERE puesto<=10""", dbl="llamadas_por_dia tasa_atencion duracion_media")
def _(v: Views):
    return roles.rank_users(roles.calls_by_user(v.calls, v.users))


@query("role_attach", """SELECT c.call_id, coalesce(u.CARGO,'Agente') AS cargo_usuario FROM calls c LEFT JOIN users u USING (TELEFONO)""")
def _(v: Views):
    return roles.attach_role(v.calls.select("call_id", "TELEFONO"), v.users).select("call_id", "cargo_usuario")
