"""Sources, mapping and cleaning (scans are in q_files)."""

from __future__ import annotations

from pyspark.sql import functions as F

from callstrata.functions import numbering
from callstrata.operators import calendar, cleaning, governance, mapping, scoring, segment
from callstrata.plans.fixtures import AS_OF_CALLS, AS_OF_LONG, Views
from callstrata.plans.registry import query
from callstrata.schema import CALL_ALIASES, FIELD_RULES, USER_ALIASES
from callstrata.sources.holidays import holiday_dim


def rows():
    return F.count(F.lit(1))


@query("holiday_dim", """SELECT h.fecha, h.descripcion, CAST(year(h.fecha) AS INTEGER) AS anio,
  CAST(month(h.fecha) AS INTEGER) AS mes, CAST(dayofyear(h.fecha) AS INTEGER) AS dia_anio, dayname(h.fecha) AS dia_semana,
  h.categoria, count(c.call_id) AS llamadas FROM hol h LEFT JOIN calls c ON CAST(c.FECHA AS DATE)=h.fecha GROUP BY ALL""")
def _(v: Views):
    per_day = v.calls.groupBy(F.to_date("FECHA").alias("fecha")).agg(rows().alias("llamadas"))
    return v.hol.join(per_day, "fecha", "left").fillna(0, ["llamadas"])


@query("scan_date_range", f"""SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
  WHERE o_orderdate >= TIMESTAMP '{AS_OF_LONG}' - INTERVAL 30 DAY AND o_orderdate < TIMESTAMP '{AS_OF_LONG}' + INTERVAL 1 DAY""",
       dbl="o_totalprice")
def _(v: Views):
    return cleaning.read_range(v.table("orders"), "o_orderdate", AS_OF_LONG).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("scan_audit_filtered", """SELECT * FROM api_calls WHERE api_provider='citas' AND created_at >= TIMESTAMP '2024-01-25'
  ORDER BY created_at DESC, id DESC LIMIT 1000""")
def _(v: Views):
    return scoring.audit_calls(v.api_calls, "citas", "2024-01-25", 1000)


@query("alias_map_calls", """SELECT f.campo, f.columna, false AS valido, (SELECT count(*) FROM calls) AS total_registros
  FROM (VALUES ('fecha','FECHA'),('hora',NULL),('tipo','SENTIDO'),('duracion','DURACION'),('agente','USUARIO')) f(campo,columna)""")
def _(v: Views):
    return mapping.alias_report(v.calls, CALL_ALIASES)


@query("alias_map_users", """SELECT true AS valido, count(*) AS total_registros, count(username_alodesk) AS usuarios_con_alodesk,
  count(*)-count(username_alodesk) AS usuarios_solo_reservo, count(DISTINCT CARGO) AS cargos_unicos FROM users""")
def _(v: Views):
    return mapping.user_mapping_report(v.users)


def _text_calls(v: Views):
    return v.calls.select(
        F.date_format("FECHA", "dd-MM-yyyy HH:mm:ss").alias("fecha_llamada"), F.col("TELEFONO").alias("numero"),
        F.col("SENTIDO").alias("direction"), F.col("ATENDIDA").alias("answered"),
        F.col("DURACION").cast("string").alias("call_time"), F.col("USUARIO").alias("agente"), F.col("CARGO").alias("puesto"),
        F.col("STATUS").alias("resultado"))


def _detect_sql(order: str) -> str:
    cols = ["fecha_llamada", "numero", "direction", "answered", "call_time", "agente", "puesto", "resultado"]
    src = """SELECT strftime(FECHA,'%d-%m-%Y %H:%M:%S') AS fecha_llamada, TELEFONO AS numero, SENTIDO AS direction,
      ATENDIDA AS answered, CAST(DURACION AS VARCHAR) AS call_time, USUARIO AS agente, CARGO AS puesto, STATUS AS resultado FROM calls"""
    names = ", ".join(f"({i},'{c}')" for i, c in enumerate(cols))
    vals = " UNION ALL ".join(f"SELECT {i} AS o, lower({c}) AS val FROM txt WHERE {c} IS NOT NULL" for i, c in enumerate(cols))
    scores = []
    for p, (field, rule) in enumerate(FIELD_RULES.items(), start=1):
        kw = "0.4*CASE WHEN regexp_matches(lower(n.c),'" + "|".join(rule["keywords"]) + "') THEN 1 ELSE 0 END"
        pats = [f"coalesce((SELECT avg(CASE WHEN regexp_matches(val,'^(?:{x})') THEN 1.0 ELSE 0.0 END) FROM vals WHERE vals.o=n.o),0)"
                for x in rule.get("patterns", [])]
        pat = f"0.35*greatest({', '.join(pats)}, 0)" if pats else "0"
        val = "0"
        if "values" in rule:
            cond = " OR ".join(f"contains(val,'{x}')" for x in rule["values"])
            val = (f"0.25*coalesce((SELECT avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END) FROM "
                   f"(SELECT DISTINCT o, val FROM vals) q WHERE q.o=n.o),0)")
        scores.append(f"SELECT n.o, n.c AS columna, '{field}' AS campo, {p} AS prioridad, least({kw}+{pat}+{val},1.0) AS puntaje FROM names n")
    return f"""WITH txt AS ({src}), names(o,c) AS (VALUES {names}), vals AS ({vals}), sc AS ({' UNION ALL '.join(scores)}),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY puntaje DESC, prioridad) r FROM sc) WHERE r=1 AND puntaje>0.3)
      SELECT campo, columna, prioridad, puntaje AS confianza FROM (SELECT *, row_number() OVER (PARTITION BY campo ORDER BY {order}) f FROM best) WHERE f=1"""


@query("field_autodetect", f"SELECT * FROM ({_detect_sql('puntaje DESC, o')})", dbl="confianza")
def _(v: Views):
    return mapping.detect_fields(_text_calls(v))


@query("field_autodetect_last_wins", f"SELECT * FROM ({_detect_sql('o DESC')})", dbl="confianza")
def _(v: Views):
    return mapping.detect_fields(_text_calls(v), keep="last")


@query("detect_confidence_bands", f"""SELECT count(*) FILTER (WHERE confianza>0.7) AS alta,
  count(*) FILTER (WHERE confianza>=0.4 AND confianza<=0.7) AS media, count(*) FILTER (WHERE confianza<0.4) AS baja,
  string_agg(campo, ',' ORDER BY prioridad) AS campos FROM ({_detect_sql('puntaje DESC, o')})""")
def _(v: Views):
    return mapping.confidence_bands(mapping.detect_fields(_text_calls(v)))


@query("mapping_validate", """SELECT problema, (SELECT count(*) FROM calls) AS filas FROM (VALUES ('falta SENTIDO'),
  ('columna inexistente NO_ESTA'),('columna repetida TELEFONO')) p(problema)""")
def _(v: Views):
    wrong = {"FECHA": "FECHA", "TELEFONO": "TELEFONO", "USUARIO": "TELEFONO", "CARGO": "NO_ESTA"}
    problems = mapping.validate_mapping(wrong, v.calls.columns)
    return v.calls.agg(rows().alias("filas")).select(
        F.explode(F.array(*[F.lit(p) for p in problems])).alias("problema"), "filas")


@query("require_columns", """SELECT columna, (SELECT count(*)=0 FROM orders) AS vacia FROM (VALUES ('FECHA'),('TELEFONO')) p(columna)""")
def _(v: Views):
    orders = v.table("orders")
    lacking = mapping.require_columns(orders.columns)
    return orders.limit(1).agg((rows() == 0).alias("vacia")).select(
        F.explode(F.array(*[F.lit(c) for c in lacking])).alias("columna"), "vacia")


@query("rename_canonical", """SELECT strptime(strftime(FECHA,'%d-%m-%Y %H:%M:%S'),'%d-%m-%Y %H:%M:%S') AS FECHA, TELEFONO, SENTIDO, ATENDIDA,
  CAST(DURACION AS VARCHAR) AS DURACION, USUARIO, CARGO, STATUS AS resultado FROM calls""")
def _(v: Views):
    renamed = mapping.apply_mapping(_text_calls(v), {
        "FECHA": "fecha_llamada", "TELEFONO": "numero", "SENTIDO": "direction", "ATENDIDA": "answered",
        "DURACION": "call_time", "USUARIO": "agente", "CARGO": "puesto"})
    return renamed.withColumn("FECHA", F.try_to_timestamp("FECHA", F.lit("dd-MM-yyyy HH:mm:ss")).cast("timestamp_ntz"))


def _direction_words(v: Views):
    t = F.col("type")
    return v.calls_raw.withColumn("type", F.when(t == "view", "Incoming").when(t == "click", "INBOUND").when(
        t == "purchase", "salida").when(t == "signup", "Outgoing").otherwise(t))


@query("standardize_calls", """SELECT try_strptime(FECHA_TXT,'%d-%m-%Y %H:%M:%S') AS fecha, CASE "type" WHEN 'view' THEN 'entrante'
  WHEN 'click' THEN 'entrante' WHEN 'purchase' THEN 'saliente' WHEN 'signup' THEN 'saliente' ELSE "type" END AS tipo,
  try_cast(duration AS DOUBLE) AS duracion, "user" AS agente FROM calls_raw""", dbl="duracion")
def _(v: Views):
    return mapping.standardize_calls(_direction_words(v), {
        "fecha": "FECHA_TXT", "tipo": "type", "duracion": "duration", "agente": "user"})


@query("standardize_users", """SELECT trim(username_reservo) AS username_reservo, trim(upper(CARGO)) AS cargo, username_alodesk,
  CASE WHEN trim(coalesce(username_alodesk, username_reservo,'WEB'))='' THEN 'WEB'
    ELSE coalesce(username_alodesk, username_reservo,'WEB') END AS usuario_display,
  username_alodesk IS NOT NULL AS tiene_alodesk FROM users""")
def _(v: Views):
    return mapping.standardize_users(v.users, mapping.map_aliases(v.users.columns, USER_ALIASES))


@query("map_user_columns", """SELECT columna, campo, (SELECT count(*) FROM users) AS usuarios FROM (VALUES ('TELEFONO','TELEFONO'),
  ('USUARIO','USUARIO'),('CARGO','CARGO')) m(columna,campo)""")
def _(v: Views):
    found = mapping.map_user_columns(v.users.select("TELEFONO", "USUARIO", "CARGO").columns)
    return v.users.agg(rows().alias("usuarios")).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("columna"), F.lit(f).alias("campo")) for c, f in found.items()])), "usuarios")


@query("clean_users", """SELECT 'EXT_'||(row_number() OVER (ORDER BY user_id)+999) AS TELEFONO,
  CASE WHEN coalesce(username_alodesk,username_reservo) IS NULL OR trim(coalesce(username_alodesk,username_reservo))='' THEN 'WEB'
    ELSE trim(coalesce(username_alodesk,username_reservo)) END AS USUARIO, CARGO FROM users""")
def _(v: Views):
    return mapping.clean_users(v.users.select("user_id", "username_reservo", "username_alodesk", "CARGO"), "user_id")


@query("clean_users_phone", """SELECT TELEFONO, CASE WHEN user_id%6=0 OR user_id%7=0 THEN 'WEB' ELSE username_alodesk END AS USUARIO,
  'Agente' AS CARGO FROM users WHERE length(TELEFONO)>5""")
def _(v: Views):
    return mapping.clean_users(v.users.select("user_id", "TELEFONO", F.col("username_alodesk").alias("USUARIO")), "user_id")


@query("parse_drop_bad_dates", """SELECT call_id, try_strptime(FECHA_TXT,'%d-%m-%Y %H:%M:%S') AS FECHA FROM calls_raw
  WHERE try_strptime(FECHA_TXT,'%d-%m-%Y %H:%M:%S') IS NOT NULL""")
def _(v: Views):
    return cleaning.parse_calls(v.calls_raw).select("call_id", "FECHA")


@query("parse_report", """SELECT count(*) AS total, count(t) AS validas, count(*)-count(t) AS invalidas FROM
  (SELECT try_strptime(FECHA_TXT,'%d-%m-%Y %H:%M:%S') AS t FROM calls_raw)""")
def _(v: Views):
    return cleaning.parse_report(v.calls_raw)


@query("derive_call_cols", """SELECT call_id, CAST(FECHA AS DATE) AS fecha_solo, CAST(hour(FECHA) AS INTEGER) AS hora,
  dayname(FECHA) AS dia_semana, CAST(month(FECHA) AS INTEGER) AS mes, CAST(year(FECHA) AS INTEGER) AS anio FROM calls""")
def _(v: Views):
    return cleaning.derive_calls(v.calls).select("call_id", "fecha_solo", "hora", "dia_semana", "mes", "anio")


@query("drop_future", f"SELECT call_id, FECHA FROM calls WHERE CAST(FECHA AS DATE) <= DATE '{AS_OF_CALLS}'")
def _(v: Views):
    return cleaning.drop_future(v.calls, AS_OF_CALLS).select("call_id", "FECHA")


@query("future_report", f"""SELECT count(*) FILTER (WHERE CAST(FECHA AS DATE)<=DATE '{AS_OF_CALLS}') AS conservadas,
  count(*) FILTER (WHERE CAST(FECHA AS DATE)>DATE '{AS_OF_CALLS}') AS futuras,
  least(max(CAST(FECHA AS DATE)), DATE '{AS_OF_CALLS}') AS fecha_corte FROM calls""")
def _(v: Views):
    return cleaning.future_report(v.calls, AS_OF_CALLS)


@query("weekday_only", "SELECT call_id, FECHA FROM calls WHERE isodow(FECHA) <= 5")
def _(v: Views):
    return cleaning.weekdays(v.calls, "FECHA").select("call_id", "FECHA")


@query("split_direction", "SELECT call_id, FECHA, TELEFONO FROM calls WHERE SENTIDO='in'")
def _(v: Views):
    return cleaning.by_direction(v.calls, "in").select("call_id", "FECHA", "TELEFONO")


@query("split_no_direction", """SELECT CASE WHEN CAST('0x'||substr(md5(CAST(call_id AS VARCHAR)),1,8) AS BIGINT) % 10000 < 6000 THEN 'in' ELSE 'out' END AS SENTIDO,
  count(*) AS llamadas FROM calls GROUP BY 1""")
def _(v: Views):
    return cleaning.hash_split(v.calls.drop("SENTIDO"), "call_id").groupBy("SENTIDO").agg(rows().alias("llamadas"))


@query("anti_remainder", "SELECT call_id FROM calls WHERE ATENDIDA <> 'Si'")
def _(v: Views):
    return cleaning.anti_remainder(v.calls.select("call_id"), v.calls.where("ATENDIDA = 'Si'"), "call_id")


_DIRTY = ("SELECT FECHA, TELEFONO, SENTIDO, ATENDIDA FROM calls UNION ALL SELECT FECHA, TELEFONO, SENTIDO, ATENDIDA FROM calls "
          "WHERE call_id%10=0 UNION ALL SELECT NULL,NULL,NULL,NULL FROM calls WHERE call_id%25=0")


def _dirty(v: Views):
    c = ["FECHA", "TELEFONO", "SENTIDO", "ATENDIDA"]
    copies = F.when(F.col("call_id") % 10 == 0, 2).otherwise(1)
    some = v.calls.select(*c, F.explode(F.array_repeat(F.lit(0), copies)).alias("_")).select(*c)
    empty = v.calls.where(F.col("call_id") % 25 == 0).select(
        *[F.lit(None).cast(v.calls.schema[x].dataType).alias(x) for x in c])
    return some.unionByName(empty)


@query("clean_rows", f"SELECT DISTINCT * FROM ({_DIRTY}) WHERE FECHA IS NOT NULL OR TELEFONO IS NOT NULL OR SENTIDO IS NOT NULL OR ATENDIDA IS NOT NULL")
def _(v: Views):
    return cleaning.clean_rows(_dirty(v))


@query("clean_report", f"""SELECT (SELECT count(*) FROM ({_DIRTY})) AS filas_iniciales, count(*) AS filas_sin_nulos,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM ({_DIRTY}) WHERE FECHA IS NOT NULL)) AS filas_finales FROM ({_DIRTY}) WHERE FECHA IS NOT NULL""")
def _(v: Views):
    return cleaning.clean_report(_dirty(v))


@query("user_search", "SELECT USUARIO, TELEFONO FROM users WHERE CARGO='Agente' AND contains(lower(USUARIO),'ser_1')")
def _(v: Views):
    return cleaning.search_users(v.users, "Agente", "SER_1").select("USUARIO", "TELEFONO")


@query("cutoff_training", "SELECT serie, ds, y FROM daily WHERE ds <= DATE '2000-06-30'")
def _(v: Views):
    return cleaning.training_cutoff(v.daily, "2000-06-30", AS_OF_LONG).select("serie", "ds", "y")


@query("training_holiday_filter", """SELECT d.serie, d.ds, d.y FROM daily d LEFT JOIN near_long n ON d.ds=n.f
  WHERE NOT (d.serie='out' AND n.f IS NOT NULL)""")
def _(v: Views):
    return calendar.training_filter(v.daily, v.hol_long).select("serie", "ds", "y")


@query("min_rows_guard", """SELECT serie, ds, y, n_filas FROM (SELECT *, count(*) OVER (PARTITION BY serie) AS n_filas FROM days_calls)
  WHERE n_filas >= 30""")
def _(v: Views):
    return cleaning.min_rows(v.days_calls).select("serie", "ds", "y", "n_filas")


@query("clip_non_negative", """SELECT serie, ds, modelo, greatest(0.0, yhat-1) AS yhat FROM forecast""", dbl="yhat")
def _(v: Views):
    return cleaning.clip_non_negative(v.forecast.withColumn("yhat", F.col("yhat") - 1), "yhat")


for _n in (30, 90, 180, None):
    _where = f"WHERE ds > m - {_n}" if _n else ""

    @query(f"time_range_filter_{_n or 'all'}", f"SELECT serie, ds, y FROM (SELECT *, max(ds) OVER (PARTITION BY serie) AS m FROM daily) {_where}")
    def _(v: Views, n=_n):
        return cleaning.last_days(v.daily, n).select("serie", "ds", "y")


@query("row_access_filter", """SELECT 7 AS viewer, event_id, user_id FROM events WHERE user_id=7
  UNION ALL SELECT 50, event_id, user_id FROM events WHERE user_id=50 OR EXISTS (SELECT 1 FROM events WHERE user_id=50)""")
def _(v: Views):
    people = v.users.select(F.col("user_id").alias("id"), "meta")
    rows = v.events.select("event_id", "user_id")
    return governance.visible_rows(rows, people, 7).select(F.lit(7).alias("viewer"), "*").unionByName(
        governance.visible_rows(rows, people, 50).select(F.lit(50).alias("viewer"), "*"))


def _retained(v: Views):
    s = governance.with_expiry(v.sessions)
    return [(s, "activities", AS_OF_LONG), (s, "logs", AS_OF_LONG), (s, "runs", AS_OF_LONG), (s, "storage", AS_OF_LONG),
            (v.api_calls, "api_calls", "2024-04-15")]


@query("retention_filter", f"""WITH s AS (SELECT *, created_at + INTERVAL 30 DAY AS expires_at FROM sessions),
  r AS (SELECT 'activities' AS regla, created_at < TIMESTAMP '{AS_OF_LONG}' - INTERVAL 1 YEAR AS g FROM s
   UNION ALL SELECT 'logs', created_at < TIMESTAMP '{AS_OF_LONG}' - INTERVAL 1 YEAR FROM s
   UNION ALL SELECT 'runs', created_at < TIMESTAMP '{AS_OF_LONG}' - INTERVAL 6 MONTH AND coalesce(status,'created') IN ('completed','failed') FROM s
   UNION ALL SELECT 'storage', expires_at < TIMESTAMP '{AS_OF_LONG}' FROM s
   UNION ALL SELECT 'api_calls', created_at < TIMESTAMP '2024-04-15' - INTERVAL 3 MONTH FROM api_calls)
  SELECT regla, count(*) FILTER (WHERE NOT g) AS conservadas, count(*) FILTER (WHERE g) AS eliminadas FROM r GROUP BY 1""")
def _(v: Views):
    parts = [governance.retention_report(*a) for a in _retained(v)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("retention_kept_rows", f"""SELECT session_id, created_at FROM sessions WHERE NOT (created_at < TIMESTAMP '{AS_OF_LONG}' - INTERVAL 6 MONTH
  AND coalesce(status,'created') IN ('completed','failed'))""")
def _(v: Views):
    return governance.retention(governance.with_expiry(v.sessions), "runs", AS_OF_LONG).select("session_id", "created_at")


@query("expiry_default", """SELECT session_id, coalesce(status,'created') AS status, created_at + INTERVAL 30 DAY AS expires_at FROM sessions""")
def _(v: Views):
    return governance.with_expiry(v.sessions).select("session_id", "status", "expires_at")


def _scan_sql() -> str:
    from callstrata.schema import SUSPICIOUS
    pats = ", ".join("('" + p.replace("'", "''") + "')" for p in SUSPICIOUS)
    return (f"SELECT 'pages' AS origen, page_id AS id, p AS patron FROM pages, (VALUES {pats}) t(p) WHERE contains(lower(html), p) "
            f"UNION ALL SELECT 'documents', doc_id, p FROM documents, (VALUES {pats}) t(p) WHERE contains(lower(text), p)")


@query("content_scan", _scan_sql())
def _(v: Views):
    pages = governance.scan_text(v.table("pages"), "page_id", "html").select(
        F.lit("pages").alias("origen"), F.col("page_id").alias("id"), "patron")
    docs = governance.scan_text(v.table("documents"), "doc_id", "text").select(
        F.lit("documents").alias("origen"), F.col("doc_id").alias("id"), "patron")
    return pages.unionByName(docs)


def _sanitize_sql() -> str:
    from callstrata.schema import LONG_PATH, LONG_PATH_MARK, SENSITIVE, SENSITIVE_MARK, TRACE_MARK
    q = lambda s: s.replace("'", "''")
    e = "text"
    for p, _ in SENSITIVE:
        e = f"regexp_replace({e}, '{q(p)}', '{SENSITIVE_MARK}', 'gi')"
    e = f"regexp_replace({e}, '{q(LONG_PATH)}', '{LONG_PATH_MARK}', 'g')"
    return (f"SELECT doc_id, CASE WHEN contains(t, chr(10)) THEN split_part(t, chr(10), 1)||'{TRACE_MARK}' ELSE t END AS limpio "
            f"FROM (SELECT doc_id, {e} AS t FROM documents)")


@query("sanitize_text", _sanitize_sql())
def _(v: Views):
    return v.table("documents").select("doc_id", governance.sanitize(F.col("text")).alias("limpio"))


@query("sanitize_marks", f"""SELECT doc_id, len(string_split(limpio,'[SENSITIVE_DATA_REMOVED]'))-1 AS marcas FROM ({_sanitize_sql()})
  WHERE contains(limpio,'[SENSITIVE_DATA_REMOVED]')""")
def _(v: Views):
    t = v.table("documents").select("doc_id", governance.sanitize(F.col("text")).alias("t"))
    return t.where(F.col("t").contains("[SENSITIVE_DATA_REMOVED]")).select(
        "doc_id", (F.size(F.split("t", r"\[SENSITIVE_DATA_REMOVED\]")) - 1).cast("long").alias("marcas"))


@query("order_check", """SELECT count(*) AS filas, count(*) FILTER (WHERE p > FECHA) AS retrocesos,
  count(*) FILTER (WHERE p > FECHA)=0 AS ordenado FROM (SELECT FECHA, lag(FECHA) OVER (ORDER BY call_id) AS p FROM calls_long)""")
def _(v: Views):
    return numbering.disorder(v.calls_long, "call_id", "FECHA")


@query("distinct_values", "SELECT DISTINCT TELEFONO FROM calls")
def _(v: Views):
    return v.calls.select("TELEFONO").distinct()


@query("preview_head", "SELECT call_id, FECHA, TELEFONO FROM calls ORDER BY call_id LIMIT 10")
def _(v: Views):
    return v.calls.select("call_id", "FECHA", "TELEFONO").orderBy("call_id").limit(10)


@query("recent_calls", "SELECT call_id, FECHA, TELEFONO FROM calls ORDER BY FECHA DESC, call_id DESC LIMIT 10")
def _(v: Views):
    return v.calls.select("call_id", "FECHA", "TELEFONO").orderBy(F.desc("FECHA"), F.desc("call_id")).limit(10)


@query("display_cap", """SELECT call_id, FECHA, (SELECT count(*) FROM calls) AS total FROM calls ORDER BY call_id LIMIT 1000""")
def _(v: Views):
    total = v.calls.agg(rows().alias("total")).scalar()
    return v.calls.select("call_id", "FECHA").orderBy("call_id").limit(1000).withColumn("total", total)


@query("sort_time", "SELECT serie, ds, y FROM days_calls ORDER BY ds, serie")
def _(v: Views):
    return v.days_calls.select("serie", "ds", "y").orderBy("ds", "serie")
