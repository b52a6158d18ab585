"""Dashboard, window and usage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callstrata.functions import dates
from callstrata.operators import audit, features, governance, insight, scoring
from callstrata.plans.fixtures import AS_OF_CALLS, AS_OF_LONG, Views
from callstrata.plans.registry import query


def rows():
    return F.count(F.lit(1))


_LABEL = "CAST(isoyear(FECHA) AS VARCHAR)||'-S'||lpad(CAST(weekofyear(FECHA) AS VARCHAR),2,'0')"
_WEEK = (f"SELECT {_LABEL} AS semana, " + ", ".join(
    f"count(*) FILTER (WHERE isodow(FECHA)={i + 1}) AS {c}" for i, c in enumerate(insight.WEEKDAY_COLS))
    + " FROM calls_long GROUP BY 1 ORDER BY 1 DESC LIMIT 20")


@query("heat_week_day", _WEEK)
def _(v: Views):
    return insight.heat_week_day(v.calls_long)


@query("heat_week_summary", f"""WITH h AS ({_WEEK}), t AS (SELECT lun+mar+mie+jue+vie+sab+dom AS t FROM h),
  d AS (SELECT 0 AS k, sum(lun) AS s FROM h UNION ALL SELECT 1, sum(mar) FROM h UNION ALL SELECT 2, sum(mie) FROM h UNION ALL SELECT 3, sum(jue) FROM h
   UNION ALL SELECT 4, sum(vie) FROM h UNION ALL SELECT 5, sum(sab) FROM h UNION ALL SELECT 6, sum(dom) FROM h)
  SELECT (SELECT k FROM d ORDER BY s DESC, k LIMIT 1) AS dia_mas_activo, avg(t) AS media_semanal, stddev_samp(t) AS desviacion_semanal FROM t""",
       dbl="media_semanal desviacion_semanal")
def _(v: Views):
    return insight.heat_week_summary(insight.heat_week_day(v.calls_long))


@query("last_weeks", f"SELECT DISTINCT {_LABEL} AS semana FROM calls_long ORDER BY 1 DESC LIMIT 20")
def _(v: Views):
    return insight.heat_week_day(v.calls_long).select("semana")


@query("heat_day_hour", "SELECT CAST(isodow(FECHA)-1 AS INTEGER) AS dia_semana, " + ", ".join(
    f"count(*) FILTER (WHERE hour(FECHA)={h}) AS h{h:02d}" for h in range(24)) + " FROM calls GROUP BY 1")
def _(v: Views):
    return insight.heat_day_hour(v.calls)


@query("hour_load", """WITH h AS (SELECT CAST(hour(FECHA) AS INTEGER) AS h, count(*) AS n FROM calls GROUP BY 1)
  SELECT first(h ORDER BY n DESC, h) AS hora_pico, max(n) AS llamadas_pico, stddev_samp(n) AS desviacion FROM h""", dbl="desviacion")
def _(v: Views):
    return insight.hour_load(v.calls)


@query("heat_calendar", """WITH d AS (SELECT CAST(FECHA AS DATE) AS ds, count(*) AS n FROM calls_long GROUP BY 1 ORDER BY 1 DESC LIMIT 90)
  SELECT ds, n, CAST(day(ds) AS INTEGER) AS dia, strftime(ds,'%Y-%m') AS mes, CAST(isodow(ds)-1 AS INTEGER) AS dia_semana,
  n/max(n) OVER ()*30+5 AS tamano, max(n) OVER () AS maximo, avg(n) OVER () AS promedio FROM d""", dbl="tamano promedio")
def _(v: Views):
    return insight.heat_calendar(v.calls_long)


@query("recent_dates_semi", """SELECT serie, ds, y FROM daily WHERE ds IN (SELECT DISTINCT ds FROM daily ORDER BY ds DESC LIMIT 90)""")
def _(v: Views):
    return insight.recent_days(v.daily).select("serie", "ds", "y")


@query("activity_insights", """WITH c AS (SELECT 'dia_semana' AS dimension, CAST(isodow(FECHA)-1 AS INTEGER) AS k, count(*) AS n FROM calls GROUP BY 2
   UNION ALL SELECT 'hora', CAST(hour(FECHA) AS INTEGER), count(*) FROM calls GROUP BY 2)
  SELECT dimension, first(k ORDER BY n DESC, k) AS pico, first(k ORDER BY n, k) AS minimo, stddev_samp(n) AS desviacion, max(n) AS maximo FROM c GROUP BY 1""",
       dbl="desviacion")
def _(v: Views):
    return insight.activity_insights(v.calls)


@query("dataset_stats", "SELECT serie, avg(y) AS promedio, max(y) AS maximo, min(y) AS minimo, count(*) AS dias FROM daily GROUP BY 1", dbl="promedio")
def _(v: Views):
    return insight.dataset_stats(v.daily)


@query("period_compare", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY serie ORDER BY ds DESC) AS r FROM daily), a AS (SELECT serie,
  avg(y) FILTER (WHERE r<=30) AS media_actual, avg(y) FILTER (WHERE r BETWEEN 31 AND 60) AS media_anterior,
  stddev_samp(y) FILTER (WHERE r<=30) AS desv_actual, stddev_samp(y) FILTER (WHERE r BETWEEN 31 AND 60) AS desv_anterior,
  max(y) FILTER (WHERE r<=30) AS max_actual, max(y) FILTER (WHERE r BETWEEN 31 AND 60) AS max_anterior FROM r GROUP BY 1 HAVING count(*)>=60)
  SELECT *, (media_actual-media_anterior)*100.0/nullif(media_anterior,0) AS cambio_media,
  (desv_actual-desv_anterior)*100.0/nullif(desv_anterior,0) AS cambio_desv, (max_actual-max_anterior)*100.0/nullif(max_anterior,0) AS cambio_max FROM a""",
       dbl="media_actual media_anterior desv_actual desv_anterior cambio_media cambio_desv cambio_max")
def _(v: Views):
    return insight.period_compare(v.daily)


_FLAGS = """SELECT serie, ds, y, m AS media_7, s AS desv_7, m+2*s AS banda_superior, m-2*s AS banda_inferior,
  (n*y-t)*(n*y-t)*(n-1) > 4*n*(n*q-t*t) AS es_anomalia FROM (SELECT serie, ds, y, avg(y) OVER w AS m, stddev_samp(y) OVER w AS s,
  count(y) OVER w AS n, sum(y) OVER w AS t, sum(y*y) OVER w AS q FROM daily
  WINDOW w AS (PARTITION BY serie ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""


@query("stability_flags", _FLAGS, dbl="media_7 desv_7 banda_superior banda_inferior")
def _(v: Views):
    return insight.stability_flags(v.daily)


@query("stability_metrics", f"""SELECT *, CASE WHEN pendiente>0.1 THEN 'creciente' WHEN pendiente<-0.1 THEN 'decreciente' ELSE 'estable' END AS tendencia,
  CASE WHEN cv_pct<20 THEN 'alta' WHEN cv_pct<35 THEN 'media' ELSE 'baja' END AS estabilidad FROM (SELECT serie,
  stddev_samp(y)*100.0/nullif(avg(y),0) AS cv_pct, count(*) FILTER (WHERE es_anomalia) AS anomalias,
  count(*) FILTER (WHERE es_anomalia)*100.0/count(*) AS pct_anomalias, regr_slope(y,p) AS pendiente
  FROM (SELECT *, row_number() OVER (PARTITION BY serie ORDER BY ds) AS p FROM ({_FLAGS})) GROUP BY 1)""", dbl="cv_pct pct_anomalias pendiente")
def _(v: Views):
    return insight.stability(v.daily)


@query("temporal_gaps", """SELECT serie, p AS desde, ds AS hasta, CAST(ds-p AS INTEGER) AS dias FROM
  (SELECT *, lag(ds) OVER (PARTITION BY serie ORDER BY ds) AS p FROM sparse) WHERE ds-p > 2""")
def _(v: Views):
    return insight.temporal_gaps(v.sparse, 2)


_DOWN = """WITH r AS (SELECT serie, ds, y, count(*) OVER (PARTITION BY serie) AS n, row_number() OVER (PARTITION BY serie ORDER BY ds) AS r FROM daily),
  e AS (SELECT *, least(1000, n//4) AS h FROM r), m AS (SELECT *, n-2*h AS mid, {mx}-2*h AS room FROM e)
  SELECT serie, ds, y FROM m WHERE n<={mx} OR r<=h OR r>n-h OR (room>0 AND mid<=room) OR (room=1 AND r=h+1)
   OR (room>1 AND list_contains(list_transform(range(room), lambda i: CASE WHEN i=room-1 THEN mid-1 ELSE CAST(floor(i*((mid-1)/(room-1))) AS BIGINT) END), r-1-h))"""


@query("plot_downsample", _DOWN.replace("{mx}", "1500"))
def _(v: Views):
    return insight.downsample(v.daily, 1500).select("serie", "ds", "y")


@query("plot_downsample_ends", _DOWN.replace("{mx}", "1000"))
def _(v: Views):
    return insight.downsample(v.daily, 1000).select("serie", "ds", "y")


@query("kpi_cards", f"""WITH e AS (SELECT *, CAST(FECHA AS DATE) AS ds FROM calls), w AS (SELECT * FROM e WHERE ds <= DATE '{AS_OF_CALLS}' AND ds > DATE '{AS_OF_CALLS}' - 20),
  d AS (SELECT isodow(ds)-1 AS k, count(*) AS n FROM w WHERE ds > DATE '{AS_OF_CALLS}' - 10 GROUP BY 1),
  c AS (SELECT * FROM w WHERE ds > DATE '{AS_OF_CALLS}' - 10)
  SELECT (SELECT count(*) FROM c) AS llamadas, (SELECT count(*) FILTER (WHERE ATENDIDA='Si')*100.0/count(*) FROM c) AS tasa_atencion,
  (SELECT max(n) FROM (SELECT count(*) n FROM c GROUP BY ds)) AS pico_diario,
  ((SELECT count(*) FROM c)-(SELECT count(*) FROM w WHERE ds <= DATE '{AS_OF_CALLS}' - 10))*100.0/(SELECT count(*) FROM w WHERE ds <= DATE '{AS_OF_CALLS}' - 10) AS cambio_pct,
  (SELECT CAST(k AS INTEGER) FROM d ORDER BY n DESC, k LIMIT 1) AS mejor_dia, (SELECT (max(n)-avg(n))*100.0/avg(n) FROM d) AS mejor_dia_vs_media,
  (SELECT max(n) FROM (SELECT count(*) n FROM c GROUP BY hour(FECHA)))*100.0/(SELECT count(*) FROM c) AS pct_hora_pico""",
       dbl="tasa_atencion cambio_pct mejor_dia_vs_media pct_hora_pico")
def _(v: Views):
    return insight.kpis(v.calls, AS_OF_CALLS, 10)


# --- features ----------------------------------------------------------------------------------

@query("date_parts", """SELECT call_id, CAST(hour(FECHA) AS INTEGER) AS hora, dayname(FECHA) AS dia, monthname(FECHA) AS mes, CAST(year(FECHA) AS INTEGER) AS anio,
  CAST(dayofyear(FECHA) AS INTEGER) AS dia_anio, strftime(FECHA,'%Y-%m') AS anio_mes, CAST(FECHA AS DATE) AS fecha, date_trunc('day', FECHA) AS normal FROM calls""")
def _(v: Views):
    f = F.col("FECHA")
    return v.calls.select("call_id", F.hour(f).alias("hora"), F.date_format(f, "EEEE").alias("dia"), F.date_format(f, "MMMM").alias("mes"),
                          F.year(f).alias("anio"), F.dayofyear(f).alias("dia_anio"), F.date_format(f, "yyyy-MM").alias("anio_mes"),
                          F.to_date(f).alias("fecha"), F.to_date(f).cast("timestamp_ntz").alias("normal"))


@query("week_label", f"SELECT DISTINCT CAST(FECHA AS DATE) AS ds, {_LABEL} AS semana FROM calls_long")
def _(v: Views):
    return v.calls_long.select(F.to_date("FECHA").alias("ds")).distinct().withColumn("semana", dates.week_label(F.col("ds")))


_CAL = """CAST(isodow(ds) AS INTEGER) AS dia_semana, CAST(day(ds) AS INTEGER) AS dia_mes, CAST(weekofyear(ds) AS INTEGER) AS semana_ano,
  CAST(month(ds) AS INTEGER) AS mes, CAST(quarter(ds) AS INTEGER) AS trimestre"""
_CYC = "sin(2*pi()*isodow(ds)/7) AS dia_semana_sin, cos(2*pi()*isodow(ds)/7) AS dia_semana_cos, sin(2*pi()*month(ds)/12) AS mes_sin, cos(2*pi()*month(ds)/12) AS mes_cos"
_CYC_COLS = "dia_semana_sin dia_semana_cos mes_sin mes_cos"


@query("calendar_features", f"SELECT serie, ds, {_CAL} FROM daily")
def _(v: Views):
    return features.calendar_features(v.daily).select("serie", "ds", "dia_semana", "dia_mes", "semana_ano", "mes", "trimestre")


@query("cyclic_features", f"SELECT serie, ds, {_CYC} FROM daily", dbl=_CYC_COLS)
def _(v: Views):
    return features.calendar_features(v.daily).select("serie", "ds", *_CYC_COLS.split())


@query("month_position", "SELECT serie, ds, CAST(day(ds)<=5 AS INTEGER) AS es_inicio_mes, CAST((day(ds)-1)//7+1 AS INTEGER) AS semana_mes FROM daily")
def _(v: Views):
    return features.month_position(v.daily).select("serie", "ds", "es_inicio_mes", "semana_mes")


_W = "PARTITION BY serie ORDER BY ds"
_LAGS = ", ".join(f"lag(y,{k}) OVER ({_W}) AS lag_{k}" for k in features.LAGS)


def _roll(agg, n, shift=0):
    o = f"OVER ({_W} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {str(shift) + ' PRECEDING' if shift else 'CURRENT ROW'})"
    return f"CASE WHEN count(*) {o}={n} THEN {agg} {o} END"


_ROLLS = ", ".join(f"{_roll('avg(y)', n)} AS media_movil_{n}, {_roll('stddev_samp(y)', n)} AS std_movil_{n}" for n in features.ROLLS)
_NUM = "(SELECT *, row_number() OVER (PARTITION BY serie ORDER BY ds) AS p FROM daily)"
_DEV = "avg(y) OVER (PARTITION BY serie, isodow(ds)) AS promedio_dia_semana, y-avg(y) OVER (PARTITION BY serie, isodow(ds)) AS desviacion_vs_promedio_dia"
_C = f"OVER ({_W} ROWS BETWEEN 7 PRECEDING AND 6 FOLLOWING)"
_Z = f"CASE WHEN count(*) {_C}=14 THEN (y-avg(y) {_C})/nullif(stddev_samp(y) {_C},0) END"
_O = f"CAST(count(*) {_C}=14 AND (14*y-sum(y) {_C})*(14*y-sum(y) {_C})*13 > 56*(14*sum(y*y) {_C}-sum(y) {_C}*sum(y) {_C}) AS INTEGER)"
_ROLL_COLS = " ".join(features.ROLL_COLS)


@query("lag_features", f"SELECT serie, ds, y, {_LAGS} FROM daily")
def _(v: Views):
    return features.lag_features(v.daily.select("serie", "ds", "y"))


@query("rolling_mean_std", f"SELECT serie, ds, y, {_ROLLS} FROM daily", dbl=_ROLL_COLS)
def _(v: Views):
    return features.rolling_mean_std(v.daily.select("serie", "ds", "y"))


@query("rolling_slope", f"SELECT serie, ds, y, {_roll('regr_slope(y,p)', 7)} AS tendencia_7d FROM {_NUM}", dbl="tendencia_7d")
def _(v: Views):
    return features.rolling_slope(v.daily.select("serie", "ds", "y"))


@query("weekday_mean_dev", f"SELECT serie, ds, y, {_DEV} FROM daily", dbl="promedio_dia_semana desviacion_vs_promedio_dia")
def _(v: Views):
    return features.weekday_mean_dev(v.daily.select("serie", "ds", "y"))


@query("centered_zscore", f"SELECT serie, ds, y, {_Z} AS z_score, {_O} AS es_outlier FROM daily", dbl="z_score")
def _(v: Views):
    return features.centered_zscore(v.daily.select("serie", "ds", "y"))


@query("feature_matrix", f"""SELECT * FROM (SELECT serie, ds, y, {_CAL}, {_CYC}, {_LAGS}, {_ROLLS},
  {_roll('regr_slope(y,p)', 7)} AS tendencia_7d, {_DEV}, {_Z} AS z_score, {_O} AS es_outlier FROM {_NUM}) WHERE lag_14 IS NOT NULL AND z_score IS NOT NULL""",
       dbl=f"{_CYC_COLS} {_ROLL_COLS} tendencia_7d promedio_dia_semana desviacion_vs_promedio_dia z_score")
def _(v: Views):
    return features.feature_matrix(v.daily)


# --- scalar functions --------------------------------------------------------------------------

@query("string_ops", """SELECT call_id, lower(STATUS) AS minus, upper(USUARIO) AS mayus, trim(' '||CARGO||' ') AS limpio, contains(USUARIO,'_1') AS tiene,
  starts_with(STATUS,'S') AS empieza, nullif(regexp_extract(TELEFONO,'(\\d+)',1),'') AS digitos, CAST(length(TELEFONO) AS INTEGER) AS largo, substring(TELEFONO,1,3) AS prefijo,
  lpad(CAST(hour(FECHA) AS VARCHAR),2,'0') AS hh, CASE SENTIDO WHEN 'in' THEN 'entrante' WHEN 'out' THEN 'saliente' END AS sentido_es FROM calls""")
def _(v: Views):
    m = F.create_map(F.lit("in"), F.lit("entrante"), F.lit("out"), F.lit("saliente"))
    return v.calls.select(
        "call_id", F.lower("STATUS").alias("minus"), F.upper("USUARIO").alias("mayus"),
        F.trim(F.concat(F.lit(" "), "CARGO", F.lit(" "))).alias("limpio"), F.col("USUARIO").contains("_1").alias("tiene"),
        F.col("STATUS").startswith("S").alias("empieza"), F.nullif(F.regexp_extract("TELEFONO", r"(\d+)", 1), F.lit("")).alias("digitos"),
        F.length("TELEFONO").alias("largo"), F.substring("TELEFONO", 1, 3).alias("prefijo"),
        F.lpad(F.hour("FECHA").cast("string"), 2, "0").alias("hh"), F.try_element_at(m, F.col("SENTIDO")).alias("sentido_es"))


@query("math_ops", """SELECT event_id, abs(value-50) AS a, sqrt(value) AS r, round_even(value,1) AS d1, greatest(0.0, value-100) AS c FROM events""", dbl="a r d1 c")
def _(v: Views):
    x = F.col("value")
    return v.events.select("event_id", F.abs(x - 50).alias("a"), F.sqrt(x).alias("r"), F.bround(x, 1).alias("d1"),
                           F.greatest(F.lit(0.0), x - 100).alias("c"))


@query("json_path", "SELECT event_id, CAST(json_extract_string(props,'$.k') AS INTEGER) AS k FROM events")
def _(v: Views):
    return v.events.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


@query("array_ops", """SELECT session_id, unnest(['session_id','user_id','status','created_at','file_info']) AS columna, 5 AS columnas FROM sessions""")
def _(v: Views):
    s = v.sessions.withColumn("cols", F.array(*[F.lit(c) for c in v.sessions.columns]))
    return s.select("session_id", F.explode("cols").alias("columna"), F.size("cols").alias("columnas"))


@query("iso_timestamp", """SELECT event_id, date_trunc('second', ts) AS t, CAST(ts AS DATE) AS d FROM events""")
def _(v: Views):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    t = F.try_to_timestamp(F.regexp_replace(text, "Z$", "")).cast("timestamp_ntz")
    return v.events.select("event_id", t.alias("t"), F.to_date(t).alias("d"))


@query("hour_from_text", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hora FROM events")
def _(v: Views):
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return v.events.select("event_id", dates.hour_of_text(text).alias("hora"))


@query("idx_extremes", """SELECT serie, first(ds ORDER BY y DESC, ds) AS dia_max, first(ds ORDER BY y, ds) AS dia_min FROM daily GROUP BY 1""")
def _(v: Views):
    from callstrata.functions.stats import arg_max, arg_min
    return v.daily.groupBy("serie").agg(arg_max("ds", "y").alias("dia_max"), arg_min("ds", "y").alias("dia_min"))


@query("top_n_group", """SELECT CARGO, hora, n, CAST(p AS INTEGER) AS puesto FROM (SELECT CARGO, CAST(hour(FECHA) AS INTEGER) AS hora, count(*) AS n,
  row_number() OVER (PARTITION BY CARGO ORDER BY count(*) DESC, hour(FECHA)) AS p FROM calls GROUP BY 1, hour(FECHA)) WHERE p<=3""")
def _(v: Views):
    from pyspark.sql import Window
    per = v.calls.groupBy("CARGO", F.hour("FECHA").alias("hora")).agg(rows().alias("n"))
    w = Window.partitionBy("CARGO").orderBy(F.desc("n"), "hora")
    return per.withColumn("puesto", F.row_number().over(w)).where("puesto <= 3")


# --- service usage and sessions ----------------------------------------------------------------

_USAGE = f"""SELECT api_provider, count(*) AS total, count(*) FILTER (WHERE success) AS exitosas, count(*) FILTER (WHERE NOT success) AS fallidas,
  avg(response_time_ms) AS latencia_media, CAST(sum(records_retrieved) AS BIGINT) AS registros, max(created_at) AS ultima,
  count(*) FILTER (WHERE success)*100.0/count(*) AS pct_exito FROM api_calls WHERE created_at >= TIMESTAMP '{AS_OF_CALLS}' - INTERVAL 30 DAY GROUP BY 1"""


@query("api_usage_stats", _USAGE, dbl="latencia_media pct_exito")
def _(v: Views):
    return scoring.api_usage(v.api_calls, AS_OF_CALLS)


@query("api_usage_daily", f"""SELECT CAST(created_at AS DATE) AS ds, count(*) AS llamadas, count(*) FILTER (WHERE success) AS exitosas FROM api_calls
  WHERE created_at >= TIMESTAMP '{AS_OF_CALLS}' - INTERVAL 10 DAY GROUP BY 1""")
def _(v: Views):
    return scoring.api_daily(v.api_calls, AS_OF_CALLS, 10)


@query("api_top_endpoints", "SELECT endpoint, count(*) AS llamadas FROM api_calls GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(v: Views):
    return scoring.api_top_endpoints(v.api_calls)


@query("integration_health", f"""SELECT api_provider, latencia_media, pct_exito, latencia_media<2000 AS latencia_ok, pct_exito>95 AS exito_ok,
  CASE WHEN latencia_media<2000 AND pct_exito>95 THEN 'OK' WHEN latencia_media>=2000 AND pct_exito<=95 THEN 'CRITICO' ELSE 'ATENCION' END AS estado
  FROM ({_USAGE})""", dbl="latencia_media pct_exito")
def _(v: Views):
    return scoring.integration_health(scoring.api_usage(v.api_calls, AS_OF_CALLS))


@query("sync_summary", """SELECT run, count(*) AS total, count(*) FILTER (WHERE success) AS exitosas, count(*) FILTER (WHERE NOT success) AS fallidas,
  count(*) FILTER (WHERE success)*100.0/count(*) AS pct_exito, CASE WHEN count(*) FILTER (WHERE NOT success)=0 THEN 'success'
  WHEN count(*) FILTER (WHERE success)>0 THEN 'partial' ELSE 'failed' END AS estado FROM (SELECT date_trunc('hour', created_at) AS run, success FROM api_calls) GROUP BY 1""",
       dbl="pct_exito")
def _(v: Views):
    return scoring.sync_summary(v.api_calls.withColumn("run", F.date_trunc("hour", "created_at").cast("timestamp_ntz")))


@query("session_stats", f"""SELECT count(*) AS total, count(*) FILTER (WHERE status='completed') AS completadas,
  avg(CAST(json_extract_string(file_info,'$.records_count') AS BIGINT)) AS promedio_registros,
  count(*) FILTER (WHERE created_at > TIMESTAMP '{AS_OF_LONG}' - INTERVAL 7 DAY) AS ultima_semana FROM sessions""", dbl="promedio_registros")
def _(v: Views):
    return scoring.session_stats(v.sessions, AS_OF_LONG)


@query("sessions_per_day", "SELECT CAST(created_at AS DATE) AS fecha, count(*) AS sesiones FROM sessions GROUP BY 1")
def _(v: Views):
    return scoring.sessions_per_day(v.sessions)


@query("paginate_sessions", """SELECT *, (SELECT count(*) FROM sessions WHERE status='completed') AS total FROM sessions WHERE status='completed'
  ORDER BY created_at DESC, session_id LIMIT 20 OFFSET 40""")
def _(v: Views):
    return scoring.paginate(v.sessions, 3, 20, status="completed")


@query("page_after_row", """SELECT * FROM sessions WHERE status='completed' AND (created_at < TIMESTAMP '1998-06-01' OR created_at = TIMESTAMP '1998-06-01' AND session_id > 100)
  ORDER BY created_at DESC, session_id LIMIT 20""")
def _(v: Views):
    return scoring.page_after(v.sessions, 20, ("1998-06-01", 100), status="completed")


# --- request rates and activity ----------------------------------------------------------------

_SEC = "SELECT endpoint AS clave, CAST(epoch(date_trunc('second', created_at)) AS BIGINT) AS s, count(*) AS n FROM api_calls GROUP BY 1,2"
_RATE = f"""SELECT clave, s, n AS n_1s, n_10s, n_60s, n_3600s, CASE WHEN n_10s>10 THEN 'rafaga' WHEN n_60s>1 THEN 'minuto' WHEN n_3600s>5 THEN 'hora' END AS violacion,
  CAST(least(n, greatest(0, n_10s-10, n_60s-1, n_3600s-5)) AS BIGINT) AS exceso FROM (SELECT *, """ + ", ".join(
    f"CAST(sum(n) OVER (PARTITION BY clave ORDER BY s RANGE BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS n_{k}s" for k in (10, 60, 3600)) + f" FROM ({_SEC}))"


def _rates(v: Views):
    return governance.sliding_rate(v.api_calls, "endpoint", "created_at", minute=1, hour=5)


@query("sliding_rate", _RATE)
def _(v: Views):
    return _rates(v)


def _block_sql(burst: int, minute: int, hour: int) -> str:
    """Blocks from single requests: each one over a limit is a violation, and a burst from the third on blocks."""
    trailing = ", ".join(f"coalesce(sum(n) OVER (PARTITION BY clave ORDER BY s RANGE BETWEEN {w - 1} PRECEDING AND 1 PRECEDING), 0) AS b{w}" for w in (10, 60, 3600))
    one = f"SELECT clave, s, n, unnest(range(1, n + 1)) AS k, b10, b60, b3600 FROM (SELECT *, {trailing} FROM ({_SEC}))"
    seconds = f"""SELECT clave, s, CASE WHEN max(b10+k)>{burst} THEN 'rafaga' WHEN max(b60+k)>{minute} THEN 'minuto' ELSE 'hora' END AS violacion,
      count(*) FILTER (WHERE b10+k>{burst} OR b60+k>{minute} OR b3600+k>{hour}) AS exceso FROM ({one}) GROUP BY 1,2"""
    total = f"SELECT clave, s, violacion, CAST(exceso AS BIGINT) AS exceso, CAST(sum(exceso) OVER (PARTITION BY clave ORDER BY s) AS BIGINT) AS acumulado FROM ({seconds}) WHERE exceso>0"
    return f"""SELECT *, CASE WHEN violacion='rafaga' AND acumulado>=3 THEN CAST(15*pow(2, least(acumulado,5)) AS INTEGER) END AS minutos_bloqueo,
      CASE WHEN violacion='rafaga' AND acumulado>=3 THEN s+CAST(15*pow(2, least(acumulado,5)) AS BIGINT)*60 END AS hasta_s FROM ({total})"""


@query("escalating_block", _block_sql(10, 1, 5))
def _(v: Views):
    return governance.escalating_block(_rates(v))


@query("escalating_block_bursts", _block_sql(1, 1, 1))
def _(v: Views):
    """The same with a burst limit that this log breaks."""
    return governance.escalating_block(governance.sliding_rate(v.api_calls, "endpoint", "created_at", burst=1, minute=1, hour=1))


@query("enforced_limits")
def _(v: Views):
    """Violations and blocks when a blocked endpoint's requests count no more."""
    return governance.enforced(v.api_calls, "endpoint", "created_at", burst=1, minute=1, hour=1)


def _limit_sql(sec: str, minute: int, hour: int) -> str:
    counts = ", ".join(f"CAST(sum(n) OVER (PARTITION BY clave ORDER BY s RANGE BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS n_{k}s" for k in (10, 60, 3600))
    return f"""SELECT clave, s, n AS n_1s, n_10s, n_60s, n_3600s, CASE WHEN n_60s>{minute} THEN 'minuto' WHEN n_3600s>{hour} THEN 'hora' END AS violacion,
      CAST(least(n, greatest(0, n_60s-{minute}, n_3600s-{hour})) AS BIGINT) AS exceso FROM (SELECT *, {counts} FROM ({sec}))"""


@query("user_rate", _limit_sql("SELECT user_id AS clave, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, count(*) AS n FROM events GROUP BY 1,2", 100, 500))
def _(v: Views):
    return governance.user_rate(v.events, "user_id", "ts")


@query("global_rate", _limit_sql("SELECT 'global' AS clave, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, count(*) AS n FROM events GROUP BY 1,2", 2, 10))
def _(v: Views):
    """All requests together against limits that this log breaks."""
    return governance.global_rate(v.events, "ts", minute=2, hour=10)


@query("top_violators", f"""SELECT clave, CAST(sum(exceso) AS BIGINT) AS violaciones FROM ({_RATE}) WHERE violacion IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(v: Views):
    return governance.top_violators(_rates(v))


@query("activity_sessions", """SELECT clave, CAST(sesion AS BIGINT) AS sesion, min(ts) AS inicio, max(ts) AS fin, count(*) AS eventos FROM (SELECT *, sum(nw) OVER (PARTITION BY clave ORDER BY ts, event_id) AS sesion
  FROM (SELECT user_id AS clave, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM events)) GROUP BY 1,2""")
def _(v: Views):
    return governance.activity_sessions(v.events, "user_id", "ts")
