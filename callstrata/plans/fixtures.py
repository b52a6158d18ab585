"""Call-centre views over the given tables, so that every operator runs on them.

``CTE`` states the same views as SQL for the checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callstrata.functions.stats import full_frame
from callstrata.operators import alerts, calendar, cleaning, ensemble, roles, segment
from callstrata.session import checkpointed
from callstrata.sources.holidays import enrich, holiday_dim

AS_OF_CALLS = "2024-01-20"
AS_OF_LONG = "2001-08-01"

# Holidays that fall on the same day every year.
FIXED_HOLIDAYS = [
    (1, 1, "Año Nuevo"), (5, 1, "Día Nacional del Trabajo"), (5, 21, "Día de las Glorias Navales"),
    (7, 16, "Día de la Virgen del Carmen"), (8, 15, "Asunción de la Virgen"), (9, 18, "Independencia Nacional"),
    (9, 19, "Día de las Glorias del Ejército"), (11, 1, "Día de Todos los Santos"),
    (12, 8, "Inmaculada Concepción"), (12, 25, "Navidad"),
]

ROLES = ["Supervisor", "Agente", "Secretaria", "Coordinadora"]
SIMPLE_MODELS = ["media", "media_dow", "media_movil", "ultimo"]


def _phone(c):
    return F.concat(F.lit("+569"), F.lpad(c.cast("string"), 8, "0"))


def _role(c):
    out = F.when(c % 4 == 0, ROLES[0])
    for i, r in enumerate(ROLES[1:], start=1):
        out = out.when(c % 4 == i, r)
    return out


class Views:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def calls(self) -> DataFrame:
        """Call log with hours over 30 days."""
        k = F.get_json_object("props", "$.k").cast("int")
        t = F.col("event_type")
        return self.events.select(
            F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp_ntz").alias("FECHA"),
            F.when(k % 17 == 0, None).otherwise(_phone(F.col("user_id"))).alias("TELEFONO"),
            F.when(t.isin("view", "click"), "in").when(t.isin("purchase", "signup"), "out").alias("SENTIDO"),
            F.when(k % 5 == 0, "No").otherwise("Si").alias("ATENDIDA"),
            F.upper(t).alias("STATUS"), F.floor("value").cast("int").alias("DURACION"),
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("USUARIO"),
            _role(F.col("user_id")).alias("CARGO"))

    @cached_property
    def calls_raw(self) -> DataFrame:
        """Call log with the date as text, some of it unreadable."""
        k = F.get_json_object("props", "$.k").cast("int")
        bad = self.events.select(F.col("event_id").alias("call_id"), (k % 23 == 0).alias("_bad"),
                                 F.date_format("ts", "dd-MM-yyyy HH:mm:ss").alias("_txt"), "user_id", "event_type", "value")
        return bad.select("call_id", F.when(F.col("_bad"), "xx").otherwise(F.col("_txt")).alias("FECHA_TXT"),
                          F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("type"),
                          F.col("value").cast("string").alias("duration"))

    @cached_property
    def calls_long(self) -> DataFrame:
        """Call log over six and a half years, without hours."""
        s = F.col("o_orderstatus")
        return self.table("orders").select(
            F.col("o_orderkey").alias("call_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("FECHA"),
            _phone(F.col("o_custkey")).alias("TELEFONO"),
            F.when(s == "F", "in").when(s == "O", "out").alias("SENTIDO"),
            F.when(F.col("o_orderpriority") == "5-LOW", "No").otherwise("Si").alias("ATENDIDA"),
            _role(F.col("o_custkey")).alias("CARGO"))

    @cached_property
    def users(self) -> DataFrame:
        """One row per user of the events table."""
        u = F.col("user_id")
        return self.events.select("user_id").distinct().select(
            "user_id", _phone(u).alias("TELEFONO"), F.concat(F.lit("user_"), u.cast("string")).alias("USUARIO"),
            _role(u).alias("CARGO"), F.concat(F.lit(" res_"), u.cast("string")).alias("username_reservo"),
            F.when(u % 6 == 0, None).when(u % 7 == 0, " ").otherwise(
                F.concat(F.lit("alo_"), u.cast("string"))).alias("username_alodesk"),
            F.when(u % 50 == 0, '{"role":"admin"}').otherwise('{"role":"user"}').alias("meta"))

    @cached_property
    def hol(self) -> DataFrame:
        return holiday_dim(self.spark)

    @cached_property
    def hol_long(self) -> DataFrame:
        """Fixed-date holidays of the years seen in the long log."""
        years = self.table("orders").select(F.year("o_orderdate").alias("y")).distinct()
        days = F.inline(F.array(*[
            F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(t).alias("descripcion"))
            for m, d, t in FIXED_HOLIDAYS]))
        return enrich(years.select("y", days).select(F.make_date("y", "m", "d").alias("fecha"), "descripcion"))

    @cached_property
    def seg(self) -> DataFrame:
        return segment.segment_calls(self.calls)

    @cached_property
    def days_calls(self) -> DataFrame:
        return calendar.complete_calendar(segment.daily_calls(self.calls))

    @cached_property
    def daily(self) -> DataFrame:
        """Gap-free daily series of the long log."""
        return calendar.complete_calendar(segment.daily_calls(self.calls_long))

    @cached_property
    def daily_table(self) -> DataFrame:
        """The daily series as a written table, for plans that read it more than once.

        The log is scanned once however many branches follow.
        """
        return checkpointed(self.daily)

    @cached_property
    def sparse(self) -> DataFrame:
        """Daily series of the long log with the days that have calls only."""
        return segment.daily_calls(self.calls_long)

    @cached_property
    def marked(self) -> DataFrame:
        """Long log with its day marks."""
        return calendar.mark_days(self.calls_long.withColumn("ds", F.to_date("FECHA")), self.hol_long)

    @cached_property
    def marked_counts(self) -> DataFrame:
        """Counts of the long log by day, role and answer, marked after counting."""
        return calendar.mark_days(roles.counted(self.calls_long, "CARGO", "ATENDIDA"), self.hol_long)

    @cached_property
    def marked_hours(self) -> DataFrame:
        """The same of the log with hours."""
        return calendar.mark_days(roles.counted(self.calls, "CARGO", "ATENDIDA"), self.hol)

    @cached_property
    def marked_calls(self) -> DataFrame:
        return calendar.mark_days(self.calls.withColumn("ds", F.to_date("FECHA")), self.hol)

    @cached_property
    def api_calls(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.events.select(
            F.col("event_id").alias("id"), F.lit("citas").alias("api_provider"),
            F.concat(F.lit("/"), "event_type").alias("endpoint"), (F.col("event_type") != "error").alias("success"),
            (F.col("value") * 10).cast("int").alias("response_time_ms"), k.alias("records_retrieved"),
            F.col("ts").cast("timestamp_ntz").alias("created_at"))

    @cached_property
    def sessions(self) -> DataFrame:
        s = F.col("o_orderstatus")
        return self.table("orders").select(
            F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"),
            F.when(s == "F", "completed").when(s == "P", "failed").alias("status"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
            F.concat(F.lit('{"records_count": '), F.col("o_custkey").cast("string"), F.lit("}")).alias("file_info"))

    # -- simple deterministic models, so that ensemble and alert operators have checked inputs ------------

    def _simple(self, hist: DataFrame, days: DataFrame) -> DataFrame:
        """(serie, ds, modelo, yhat): overall mean, weekday mean, mean of the last 28 rows, last value."""
        w = Window.partitionBy("serie").orderBy(F.desc("ds"))
        recent = hist.withColumn("_r", F.row_number().over(w)).groupBy("serie").agg(
            F.avg("y").alias("media"), F.avg(F.when(F.col("_r") <= 28, F.col("y"))).alias("media_movil"),
            F.max(F.when(F.col("_r") == 1, F.col("y"))).cast("double").alias("ultimo"))
        based = ensemble.weekday_baseline(days, hist).withColumnRenamed("base", "media_dow").join(recent, "serie")
        keep = [c for c in days.columns]
        return based.select(*keep, F.inline(F.array(*[
            F.struct(F.lit(m).alias("modelo"), F.col(m).alias("yhat")) for m in SIMPLE_MODELS])))

    @cached_property
    def forecast(self) -> DataFrame:
        return self._simple(self.daily_table, calendar.future_days(self.daily_table, 28))

    @cached_property
    def pairs(self) -> DataFrame:
        """Back-test: the last 30 rows of each series predicted from the rows before."""
        w = Window.partitionBy("serie").orderBy(F.desc("ds"))
        split = self.daily_table.select("serie", "ds", "y").withColumn("_r", F.row_number().over(w))
        train = split.where("_r > 30").drop("_r")
        test = split.where("_r <= 30").select("serie", "ds", "y")
        return self._simple(train, test)

    @cached_property
    def metrics(self) -> DataFrame:
        return ensemble.error_metrics(self.pairs)

    @cached_property
    def weights(self) -> DataFrame:
        return checkpointed(ensemble.ensemble_weights(self.metrics))

    @cached_property
    def fc(self) -> DataFrame:
        return checkpointed(ensemble.forecast_table(self.forecast, self.weights, SIMPLE_MODELS))

    @cached_property
    def alerts(self) -> DataFrame:
        return alerts.demand_alerts(self.fc, self.daily_table)

    @cached_property
    def runs(self) -> DataFrame:
        """One run per series and ISO week: score from the weekly change, error from the weekly spread."""
        weeks = self.daily.groupBy("serie", F.date_trunc("week", F.col("ds").cast("timestamp_ntz")).cast(
            "timestamp_ntz").alias("run_ts")).agg(F.sum("y").alias("total"), F.stddev_pop("y").alias("mae"))
        prev = F.lag("total").over(Window.partitionBy("serie").orderBy("run_ts"))
        change = F.abs(F.try_divide((F.col("total") - prev) * 100.0, prev))
        return weeks.withColumn("score", 100 - F.least(F.lit(100.0), F.coalesce(change, F.lit(0.0)))).select(
            "serie", "run_ts", "score", "mae")


_ROLE = lambda c: "CASE " + " ".join(f"WHEN {c}%4={i} THEN '{r}'" for i, r in enumerate(ROLES)) + " END"
_PHONE = lambda c: f"'+569'||lpad(CAST({c} AS VARCHAR),8,'0')"
_FIXED = ", ".join(f"({m},{d},'{t}')" for m, d, t in FIXED_HOLIDAYS)


def category_sql(c: str) -> str:
    from callstrata.schema import HOLIDAY_KEYWORDS, HOLIDAY_OTHER
    whens = " ".join(f"WHEN regexp_matches(lower({c}),'{'|'.join(w)}') THEN '{k}'" for k, w in HOLIDAY_KEYWORDS)
    return f"CASE {whens} ELSE '{HOLIDAY_OTHER}' END"


def hol_sql() -> str:
    from callstrata.sources.holidays import NATIONAL_HOLIDAYS
    rows = ", ".join(f"('{f}','{d}')" for f, d in NATIONAL_HOLIDAYS)
    return (f"SELECT CAST(strptime(f,'%d-%m-%Y') AS DATE) AS fecha, d AS descripcion, {category_sql('d')} AS categoria "
            f"FROM (VALUES {rows}) v(f,d)")


def near_sql(src: str) -> str:
    return (f"SELECT f, bool_or(k=0) AS es_feriado, max(CASE WHEN k=0 THEN descripcion END) AS feriado_descripcion, "
            f"max(CASE WHEN k=0 THEN categoria END) AS feriado_categoria, bool_or(k=-1) AS pre_feriado, "
            f"bool_or(k=1) AS post_feriado FROM (SELECT fecha + CAST(k AS INTEGER) AS f, k, descripcion, categoria FROM {src}, "
            f"(VALUES (-1),(0),(1)) t(k)) GROUP BY f")


def marked_sql(src: str, near: str, d: str = "ds") -> str:
    return f"""SELECT *, (es_feriado AND isodow({d}) IN (1,5)) OR (isodow({d})>=6 AND (pre_feriado OR post_feriado)) AS fin_semana_largo,
      CASE WHEN es_feriado THEN 'Feriado ('||feriado_categoria||')'
           WHEN isodow({d})>=6 AND (pre_feriado OR post_feriado) THEN 'Fin de Semana Largo'
           WHEN pre_feriado THEN 'Pre-Feriado' WHEN post_feriado THEN 'Post-Feriado'
           WHEN isodow({d})>=6 THEN 'Fin de Semana' ELSE 'Día Laboral' END AS tipo_dia
      FROM (SELECT c.*, coalesce(n.es_feriado,false) AS es_feriado, n.feriado_descripcion,
              coalesce(n.feriado_categoria,'Normal') AS feriado_categoria,
              coalesce(n.pre_feriado,false) AS pre_feriado, coalesce(n.post_feriado,false) AS post_feriado
            FROM {src} c LEFT JOIN {near} n ON c.{d}=n.f)"""


def _daily_sql(src: str) -> str:
    return (f"SELECT SENTIDO AS serie, CAST(FECHA AS DATE) AS ds, count(TELEFONO) AS y, "
            f"count(*) FILTER (WHERE ATENDIDA='Si') AS atendidas, avg(hour(FECHA)) AS hora_promedio "
            f"FROM {src} WHERE SENTIDO IS NOT NULL GROUP BY 1,2")


def _complete_sql(src: str) -> str:
    return (f"SELECT g.serie, g.ds, coalesce(d.y,0) AS y, coalesce(d.atendidas,0) AS atendidas, d.hora_promedio FROM "
            f"(SELECT serie, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS ds FROM "
            f"(SELECT serie, min(ds) a, max(ds) b FROM {src} GROUP BY serie)) g "
            f"LEFT JOIN {src} d ON g.serie=d.serie AND g.ds=d.ds")


def _simple_sql(hist: str, days: str, cols: str) -> str:
    return f"""SELECT {cols}, m.modelo, CASE m.modelo WHEN 'media' THEN o.media WHEN 'media_movil' THEN o.media_movil
        WHEN 'ultimo' THEN o.ultimo ELSE coalesce(w.m, o.media) END AS yhat
      FROM {days} d JOIN (SELECT serie, avg(y) AS media, avg(y) FILTER (WHERE r<=28) AS media_movil,
          CAST(max(y) FILTER (WHERE r=1) AS DOUBLE) AS ultimo
          FROM (SELECT *, row_number() OVER (PARTITION BY serie ORDER BY ds DESC) r FROM {hist}) GROUP BY serie) o USING (serie)
      LEFT JOIN (SELECT serie, isodow(ds) AS dw, avg(y) AS m FROM {hist} GROUP BY 1,2) w ON w.serie=d.serie AND w.dw=isodow(d.ds)
      CROSS JOIN (VALUES ('media'),('media_dow'),('media_movil'),('ultimo')) m(modelo)"""


_E1 = lambda f, c: f"printf('{f}', {c})"


def alerts_sql(fc: str, daily: str) -> str:
    y, crit, high, low = "yhat_ensemble", "(m+2.5*s)", "(m+1.5*s)", "(m-1.5*s)"
    sure = lambda cap, cond, d: f"CASE WHEN {cond} THEN least({cap}, 1-yhat_std/{d}) ELSE 0.5 END"
    base = (f"SELECT f.*, t.m, t.s FROM {fc} f JOIN (SELECT serie, avg(y) m, stddev_samp(y) s FROM {daily} GROUP BY serie) t "
            f"USING (serie)")
    row = lambda tipo, sev, val, umb, inc, msg, acc, conf, cond: (
        f"SELECT serie, {tipo} AS tipo, {sev} AS severidad, ds AS fecha, CAST({val} AS DOUBLE) AS valor_predicho, "
        f"CAST({umb} AS DOUBLE) AS umbral, CAST({inc} AS DOUBLE) AS incertidumbre, {msg} AS mensaje, {acc} AS accion, "
        f"CAST({conf} AS DOUBLE) AS confianza FROM ({base}) WHERE {cond}")
    r1 = lambda c: f"round_even({c},1)"
    parts = [
        row("'DEMANDA_EXTREMA'", "'CRITICA'", r1(y), r1(crit), "NULL",
            _E1("Demanda extrema predicha: %.1f llamadas (>+2.5σ histórico)", y),
            "'Activar protocolo de emergencia, personal adicional urgente'", sure(0.95, f"{y}>0", y), f"{y}>{crit}"),
        row("'DEMANDA_ALTA'", "'ALTA'", r1(y), r1(high), "NULL",
            _E1("Alta demanda predicha: %.1f llamadas (>+1.5σ histórico)", y),
            "'Programar personal adicional, revisar capacidad'", sure(0.9, f"{y}>0", y), f"{y}>{high} AND NOT {y}>{crit}"),
        row("'DEMANDA_BAJA'", "'MEDIA'", r1(y), r1(low), "NULL",
            _E1("Baja demanda predicha: %.1f llamadas (<-1.5σ histórico)", y),
            "'Considerar reducir turnos o reasignar personal'", sure(0.85, f"{y}<>0", f"abs({y})"),
            f"{y}<{low} AND NOT {y}>{high} AND NOT {y}>{crit}"),
        row("'ALTA_INCERTIDUMBRE'", "'MEDIA'", r1(y), "NULL", r1("yhat_std"),
            f"printf('Alta incertidumbre: ±%.1f llamadas (', yhat_std)||coalesce(printf('%.1f', yhat_std/nullif({y},0)*100),'-')"
            "||'% de la predicción)'",
            "'Monitorear de cerca, mantener personal de contingencia'", "0.6", f"yhat_std > {y}*0.3"),
        row("'LUNES_ALTO'", "'ALTA'", r1(y), "NULL", "NULL",
            _E1("Lunes con demanda alta: %.1f llamadas (efecto post-weekend)", y),
            "'Reforzar equipo de lunes, preparar gestión de cola'", "0.8", f"isodow(ds)=1 AND {y}>m*1.3"),
        f"""SELECT serie, 'TENDENCIA_CRECIENTE', 'MEDIA', max(ds), NULL, NULL, NULL,
          'Tendencia creciente sostenida en próximos 5 días', 'Revisar capacidad para siguiente semana', 0.75
          FROM (SELECT serie, ds, row_number() OVER (PARTITION BY serie ORDER BY ds DESC) r,
             {y} > lag({y}) OVER (PARTITION BY serie ORDER BY ds) up FROM {fc}) WHERE r<=5 GROUP BY serie
          HAVING count(*)=5 AND bool_and(CASE WHEN r<5 THEN up ELSE true END)""",
    ]
    return " UNION ALL ".join(parts)


# The views as SQL; a query takes the ones it names.
CTE: dict[str, str] = {
    "calls": f"""SELECT event_id AS call_id, ts AS FECHA, CASE WHEN k%17=0 THEN NULL ELSE {_PHONE('user_id')} END AS TELEFONO,
      CASE WHEN event_type IN ('view','click') THEN 'in' WHEN event_type IN ('purchase','signup') THEN 'out' END AS SENTIDO,
      CASE WHEN k%5=0 THEN 'No' ELSE 'Si' END AS ATENDIDA, upper(event_type) AS STATUS,
      CAST(floor(value) AS INTEGER) AS DURACION, 'user_'||user_id AS USUARIO, {_ROLE('user_id')} AS CARGO
      FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS INTEGER) AS k FROM events)""",
    "calls_raw": """SELECT event_id AS call_id, CASE WHEN CAST(json_extract_string(props,'$.k') AS INTEGER)%23=0 THEN 'xx'
      ELSE strftime(ts,'%d-%m-%Y %H:%M:%S') END AS FECHA_TXT, CAST(user_id AS VARCHAR) AS "user", event_type AS "type",
      CAST(value AS VARCHAR) AS duration FROM events""",
    "calls_long": f"""SELECT o_orderkey AS call_id, o_orderdate AS FECHA, {_PHONE('o_custkey')} AS TELEFONO,
      CASE o_orderstatus WHEN 'F' THEN 'in' WHEN 'O' THEN 'out' END AS SENTIDO,
      CASE WHEN o_orderpriority='5-LOW' THEN 'No' ELSE 'Si' END AS ATENDIDA, {_ROLE('o_custkey')} AS CARGO FROM orders""",
    "users": f"""SELECT user_id, {_PHONE('user_id')} AS TELEFONO, 'user_'||user_id AS USUARIO, {_ROLE('user_id')} AS CARGO,
      ' res_'||user_id AS username_reservo,
      CASE WHEN user_id%6=0 THEN NULL WHEN user_id%7=0 THEN ' ' ELSE 'alo_'||user_id END AS username_alodesk,
      CASE WHEN user_id%50=0 THEN '{{"role":"admin"}}' ELSE '{{"role":"user"}}' END AS meta
      FROM (SELECT DISTINCT user_id FROM events)""",
    "hol": hol_sql(),
    "hol_long": f"""SELECT make_date(y,m,d) AS fecha, t AS descripcion, {category_sql('t')} AS categoria
      FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders), (VALUES {_FIXED}) v(m,d,t)""",
    "near": near_sql("hol"),
    "near_long": near_sql("hol_long"),
    "seg": """SELECT *, CASE WHEN SENTIDO='in' THEN 'ENTRANTE' WHEN SENTIDO='out' THEN 'SALIENTE'
        WHEN hora BETWEEN 8 AND 17 THEN 'ENTRANTE' WHEN hora IS NOT NULL THEN 'SALIENTE' ELSE 'INDETERMINADA' END AS tipo_llamada,
      CASE WHEN SENTIDO IN ('in','out') THEN 0.9 WHEN hora BETWEEN 8 AND 17 THEN 0.8 WHEN hora BETWEEN 18 AND 19 THEN 0.7
        WHEN hora IS NOT NULL THEN 0.9 ELSE 0.0 END::DOUBLE AS confianza_segmentacion
      FROM (SELECT *, hour(FECHA) AS hora FROM calls)""",
    "sparse_calls": _daily_sql("calls"),
    "days_calls": _complete_sql("sparse_calls"),
    "sparse": _daily_sql("calls_long"),
    "daily": _complete_sql("sparse"),
    "marked": marked_sql("(SELECT *, CAST(FECHA AS DATE) AS ds FROM calls_long)", "near_long"),
    "marked_calls": marked_sql("(SELECT *, CAST(FECHA AS DATE) AS ds FROM calls)", "near"),
    "api_calls": """SELECT event_id AS id, 'citas' AS api_provider, '/'||event_type AS endpoint, event_type<>'error' AS success,
      CAST(trunc(value*10) AS INTEGER) AS response_time_ms, CAST(json_extract_string(props,'$.k') AS INTEGER) AS records_retrieved,
      ts AS created_at FROM events""",
    "sessions": """SELECT o_orderkey AS session_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'completed'
      WHEN 'P' THEN 'failed' END AS status, o_orderdate AS created_at, '{"records_count": '||o_custkey||'}' AS file_info FROM orders""",
    "future": """SELECT serie, CAST(unnest(generate_series(l + INTERVAL 1 DAY, l + INTERVAL 28 DAY, INTERVAL 1 DAY)) AS DATE) AS ds
      FROM (SELECT serie, max(ds) AS l FROM daily GROUP BY serie)""",
    "forecast": _simple_sql("daily", "future", "d.serie, d.ds"),
    "split30": "SELECT *, row_number() OVER (PARTITION BY serie ORDER BY ds DESC) AS r FROM (SELECT serie, ds, y FROM daily)",
    "train30": "SELECT serie, ds, y FROM split30 WHERE r>30",
    "test30": "SELECT serie, ds, y FROM split30 WHERE r<=30",
    "pairs": _simple_sql("train30", "test30", "d.serie, d.ds, d.y"),
    "metrics": """SELECT serie, modelo, avg(abs(y-yhat)) AS mae, sqrt(avg((y-yhat)*(y-yhat))) AS rmse,
      avg(CASE WHEN y<>0 THEN abs(y-yhat)/abs(y) END)*100 AS mape,
      1-sum((y-yhat)*(y-yhat))/nullif(var_pop(y)*count(y),0) AS r2, count(*) AS n, count(*) FILTER (WHERE y=0) AS dias_cero
      FROM pairs GROUP BY 1,2""",
    "weights": """SELECT serie, modelo, mae, c/sum(c) OVER (PARTITION BY serie) AS peso FROM (SELECT serie, modelo, mae,
      greatest(0.1, least(0.5, (1/mae)/sum(1/mae) OVER (PARTITION BY serie))) AS c FROM metrics)""",
    "fc": """SELECT serie, ds, greatest(0.0,e) AS yhat_ensemble, sd AS yhat_std, greatest(0.0,e-1.96*sd) AS yhat_lower,
      e+1.96*sd AS yhat_upper, media AS yhat_media, media_dow AS yhat_media_dow, media_movil AS yhat_media_movil, ultimo AS yhat_ultimo
      FROM (SELECT f.serie, f.ds, sum(peso*yhat)/sum(peso) AS e, stddev_pop(yhat) AS sd,
        max(yhat) FILTER (WHERE modelo='media') AS media, max(yhat) FILTER (WHERE modelo='media_dow') AS media_dow,
        max(yhat) FILTER (WHERE modelo='media_movil') AS media_movil, max(yhat) FILTER (WHERE modelo='ultimo') AS ultimo
        FROM forecast f JOIN weights w USING (serie, modelo) GROUP BY 1,2)""",
    "alerts": alerts_sql("fc", "daily"),
    "runs": """SELECT serie, run_ts, 100-least(100.0, coalesce(abs((total-p)*100.0/nullif(p,0)),0.0)) AS score, mae FROM
      (SELECT *, lag(total) OVER (PARTITION BY serie ORDER BY run_ts) AS p FROM
        (SELECT serie, CAST(date_trunc('week', ds) AS TIMESTAMP) AS run_ts, sum(y) AS total, stddev_pop(y) AS mae FROM daily GROUP BY 1,2))""",
    "perf": """SELECT *, CASE WHEN score_general>=80 THEN 'EXCELENTE' WHEN score_general>=60 THEN 'BUENO' WHEN score_general>=40
      THEN 'REQUIERE_ATENCION' ELSE 'CRITICO' END AS estado FROM (SELECT *, avg(score) OVER () AS score_general FROM
      (SELECT *, (ok_mae::INT+ok_modelos::INT+ok_predicciones::INT)/3.0*100 AS score FROM
      (SELECT w.*, coalesce(f.n,0) AS predicciones, coalesce(a.n,0) AS alertas, coalesce(a.c,0) AS alertas_criticas,
        coalesce(mae_ensemble<=10,false) AS ok_mae, modelos_activos>=3 AS ok_modelos, coalesce(f.n,0)>=20 AS ok_predicciones
       FROM (SELECT serie, sum(mae*peso) FILTER (WHERE mae>0)/sum(peso) FILTER (WHERE mae>0) AS mae_ensemble,
           count(*) AS modelos_activos, first(modelo ORDER BY peso DESC, modelo) AS mejor_modelo FROM weights GROUP BY serie) w
       LEFT JOIN (SELECT serie, count(*) n FROM fc GROUP BY serie) f USING (serie)
       LEFT JOIN (SELECT serie, count(*) n, count(*) FILTER (WHERE severidad='CRITICA') c FROM alerts GROUP BY serie) a USING (serie))))""",
}
