"""File sources and sinks: each query writes files derived from the tables to shared storage and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from callstrata.operators import audit, cleaning, governance, segment
from callstrata.plans.fixtures import Views
from callstrata.plans.registry import query
from callstrata.session import shared_dir
from callstrata.sources import calls as src
from callstrata.sources import runs, sinks
from callstrata.sources.holidays import NATIONAL_HOLIDAYS, holiday_dim


def rows():
    return F.count(F.lit(1))


_TXT_COLS = ["call_id", "FECHA", "TELEFONO", "SENTIDO", "ATENDIDA", "DURACION", "CARGO"]
# Role names with letters beyond ASCII.
_ACCENT = {"Supervisor": "Supervisión", "Agente": "Atención", "Secretaria": "Secretaría", "Coordinadora": "Señalización"}


def _as_text(v: Views, accents: bool = False):
    role = F.col("CARGO")
    if accents:
        for a, b in _ACCENT.items():
            role = F.when(F.col("CARGO") == a, b).otherwise(role)
    return v.calls.select(
        F.col("call_id").cast("string").alias("call_id"), F.date_format("FECHA", "dd-MM-yyyy HH:mm:ss").alias("FECHA"), "TELEFONO",
        "SENTIDO", "ATENDIDA", F.col("DURACION").cast("string").alias("DURACION"), role.alias("CARGO"))


_CALLS_TXT = """SELECT call_id, date_trunc('second', FECHA) AS FECHA, TELEFONO, SENTIDO, ATENDIDA, DURACION, {role} AS CARGO FROM calls"""
_ROLE_SQL = "CASE CARGO " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _ACCENT.items()) + " END"


def _typed(df):
    return src.typed_calls(df).withColumn("call_id", F.col("call_id").cast("long"))


@query("scan_calls_csv", _CALLS_TXT.format(role="CARGO"))
def _(v: Views):
    path = sinks.write_csv(_as_text(v).toDF(*[f" {c} " for c in _TXT_COLS]), shared_dir(v.spark, "log"), sep=";")
    return _typed(src.read_calls(v.spark, path))


def _mixed_folder(v: Views) -> str:
    """Three parts of the log, each with its own charset and separator."""
    root, log = shared_dir(v.spark, "mixed"), _as_text(v, accents=True)
    for name, cond, sep, enc in (("a", F.col("SENTIDO") == "in", ";", "UTF-8"), ("b", F.col("SENTIDO") == "out", ",", "ISO-8859-1"),
                                 ("c", F.col("SENTIDO").isNull(), "\t", "UTF-8")):
        sinks.write_csv(log.where(cond), f"{root}/{name}", sep=sep, encoding=enc)
    return root


@query("csv_charset_route", _CALLS_TXT.format(role=_ROLE_SQL))
def _(v: Views):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in _TXT_COLS])
    return _typed(src.read_mixed(v.spark, _mixed_folder(v), schema))


@query("csv_charset_by_file", "SELECT CASE WHEN SENTIDO='out' THEN 'ISO-8859-1' ELSE 'UTF-8' END AS charset, count(*) AS filas FROM calls GROUP BY 1")
def _(v: Views):
    root = _mixed_folder(v)
    lines = src.text_lines(v.spark, root).groupBy("archivo").agg((rows() - 1).alias("n"))
    return src.detect_charset(v.spark, root).join(lines, "archivo").groupBy("charset").agg(F.sum("n").alias("filas"))


@query("csv_separator_sniff", """SELECT CASE SENTIDO WHEN 'in' THEN ';' WHEN 'out' THEN ',' ELSE 'tab' END AS sep, count(*) AS filas FROM calls GROUP BY 1""")
def _(v: Views):
    root = _mixed_folder(v)
    lines = src.text_lines(v.spark, root).groupBy("archivo").agg((rows() - 1).alias("n"))
    return src.sniff_sep(v.spark, root).join(lines, "archivo").groupBy(
        F.when(F.col("sep") == "\t", "tab").otherwise(F.col("sep")).alias("sep")).agg(F.sum("n").alias("filas"))


def _json_cols(v: Views):
    return v.calls.select("call_id", "TELEFONO", "SENTIDO", "ATENDIDA", "DURACION")


_JSON_SQL = "SELECT call_id, TELEFONO, SENTIDO, ATENDIDA, CAST(DURACION AS BIGINT) AS DURACION FROM calls"


@query("scan_json_nested", _JSON_SQL)
def _(v: Views):
    """Objects of up to a thousand records each, read with a stated schema."""
    base = _json_cols(v)
    batches = base.groupBy(F.floor(F.col("call_id") / 1000).alias("lote")).agg(
        F.collect_list(F.struct(*base.columns)).alias("registros"))
    path = sinks.write_report(batches, shared_dir(v.spark, "json"))
    return src.read_json_records(v.spark, path, batches.schema).withColumn("DURACION", F.col("DURACION").cast("long"))


@query("scan_json_objects", _JSON_SQL)
def _(v: Views):
    """One object per line."""
    base = _json_cols(v)
    path = sinks.write_report(base, shared_dir(v.spark, "json"))
    return src.read_json_records(v.spark, path, base.schema).withColumn("DURACION", F.col("DURACION").cast("long"))


@query("scan_latest_result", "SELECT ds, yhat FROM forecast WHERE serie='in' AND modelo='media_dow'", dbl="yhat")
def _(v: Views):
    """Two runs stored for a call type, the older one with other numbers; the newer is read."""
    root = shared_dir(v.spark, "results")
    fc = v.forecast.where("serie = 'in'")
    for stamp, model in (("20010701", "media"), ("20010801", "media_dow")):
        report = fc.where(F.col("modelo") == model).groupBy("serie").agg(
            F.collect_list(F.struct("ds", "yhat")).alias("predicciones"))
        sinks.write_report(report, f"{root}/resultado_in_{stamp}")
    return src.latest_result(v.spark, root, "in").select(F.col("ds").cast("date").alias("ds"), "yhat")


@query("file_inventory")
def _(v: Views):
    root = sinks.write_csv(v.days_calls, shared_dir(v.spark, "inventory"), by="serie")
    return src.file_inventory(v.spark, root).select("nombre", "bytes", "modificado")


def _killed(df, root: str) -> None:
    """What a run leaves that ended before its commit."""
    df.write.mode("append").json(f"{root}/data/20991231/killed/pronostico")


@query("run_inventory", """SELECT corrida, tabla, filas FROM (SELECT '20010701' AS corrida, 'diario' AS tabla, count(*) AS filas FROM daily UNION ALL
  SELECT '20010701', 'pronostico', count(*) FROM forecast UNION ALL SELECT '20010801', 'pronostico', count(*) FROM forecast WHERE modelo='media_dow')""")
def _(v: Views):
    """Tables and rows of the committed runs, from the log; one run was killed and one was repeated."""
    root = shared_dir(v.spark, "runs")
    runs.write_run(v.spark, root, "20010801", {"pronostico": v.forecast.limit(3)})
    runs.write_run(v.spark, root, "20010701", {"diario": v.daily, "pronostico": v.forecast}, "parquet", {"diario": "serie"})
    runs.write_run(v.spark, root, "20010801", {"pronostico": v.forecast.where("modelo = 'media_dow'")}, "csv")
    _killed(v.forecast, root)
    return runs.inventory(v.spark, root).select("corrida", "tabla", "filas")


@query("run_latest", "SELECT serie, ds, yhat FROM forecast WHERE modelo='media_dow'", dbl="yhat")
def _(v: Views):
    """The table of the run committed last, whatever a killed run has left."""
    root, schema = shared_dir(v.spark, "runs"), "serie string, ds date, modelo string, yhat double"
    fc = v.forecast.select("serie", "ds", "modelo", F.col("yhat").cast("double").alias("yhat"))
    runs.write_run(v.spark, root, "20010701", {"pronostico": fc.where("modelo = 'media'")})
    runs.write_run(v.spark, root, "20010801", {"pronostico": fc.where("modelo = 'media_dow'")})
    _killed(fc, root)
    return runs.read_run(v.spark, root, "pronostico", schema).select("serie", "ds", "yhat")


@query("sink_csv", "SELECT tipo_llamada, CAST(FECHA AS DATE) AS ds, count(*) AS n FROM seg GROUP BY 1,2")
def _(v: Views):
    per_day = v.seg.groupBy("tipo_llamada", F.to_date("FECHA").alias("ds")).agg(rows().alias("n"))
    path = sinks.write_csv(per_day, shared_dir(v.spark, "csv"), by="tipo_llamada")
    return v.spark.read.option("header", True).schema("ds date, n bigint, tipo_llamada string").csv(path)


@query("sink_json_report", """SELECT (SELECT count(*) FROM calls) AS total, (SELECT count(*) FROM (SELECT DISTINCT hour(FECHA) FROM calls)) AS horas,
  (SELECT count(*) FILTER (WHERE ATENDIDA='Si') FROM calls) AS atendidas""")
def _(v: Views):
    report = sinks.nested_report(v.spark, resumen=audit.audit_summary(v.calls), por_hora=segment.calls_per_hour(v.calls))
    path = sinks.write_report(report, shared_dir(v.spark, "report"))
    back = v.spark.read.schema(report.schema).json(path)
    return back.select(F.col("resumen")[0]["total"].alias("total"), F.size("por_hora").cast("long").alias("horas"),
                       F.col("resumen")[0]["atendidas"].alias("atendidas"))


@query("holiday_csv", "SELECT h.fecha, h.descripcion, h.categoria, count(c.call_id) AS llamadas FROM hol h LEFT JOIN calls c ON CAST(c.FECHA AS DATE)=h.fecha GROUP BY ALL")
def _(v: Views):
    """The holiday list read from a CSV, next to the calls of each date."""
    rows_ = v.spark.createDataFrame(NATIONAL_HOLIDAYS, "`Fecha (dd-mm-yyyy)` string, `Descripcion feriado` string").coalesce(1)
    path = sinks.write_csv(rows_, shared_dir(v.spark, "holidays"))
    per_day = v.calls.groupBy(F.to_date("FECHA").alias("fecha")).agg(rows().alias("llamadas"))
    return holiday_dim(v.spark, path).join(per_day, "fecha", "left").fillna(0, ["llamadas"]).select(
        "fecha", "descripcion", "categoria", "llamadas")


_NAMES = """CASE page_id%9 WHEN 0 THEN 'datos'||page_id||'.csv' WHEN 1 THEN 'CON.csv' WHEN 2 THEN '.oculto.csv' WHEN 3 THEN 'a:b.csv' WHEN 4 THEN 'sin_extension'
  WHEN 5 THEN 'x.exe' WHEN 6 THEN 'hoja.xlsx' WHEN 7 THEN '..csv' ELSE repeat('n',260)||'.csv' END"""


@query("file_rules", f"""SELECT page_id, nombre, bytes, CASE WHEN length(nombre)>255 THEN 'nombre demasiado largo'
  WHEN contains(nombre,'..') OR regexp_matches(nombre,'[/:]') THEN 'caracter no permitido' WHEN nombre='CON.csv' THEN 'nombre reservado'
  WHEN starts_with(nombre,'.') THEN 'archivo oculto' WHEN bytes<100 THEN 'demasiado pequeño' WHEN bytes>52428800 THEN 'demasiado grande'
  WHEN nombre IN ('sin_extension','x.exe') THEN 'tipo no permitido' WHEN ends_with(nombre,'.csv') AND lineas<2 THEN 'menos de dos líneas'
  WHEN ends_with(nombre,'.csv') AND NOT regexp_matches(cabecera,'[;,\\t]') THEN 'sin separador'
  WHEN ends_with(nombre,'.xlsx') AND bytes<1000 THEN 'hoja corrupta' END AS motivo FROM
  (SELECT page_id, {_NAMES} AS nombre, strlen(html) AS bytes, len(string_split(html, chr(10))) AS lineas, split_part(html, chr(10), 1) AS cabecera FROM pages)""")
def _(v: Views):
    p = v.table("pages").select(
        "page_id", F.expr(_NAMES).alias("nombre"), F.octet_length("html").cast("long").alias("bytes"),
        F.size(F.split("html", "\n")).alias("lineas"), F.substring_index("html", "\n", 1).alias("cabecera"))
    return governance.file_verdicts(p, "page_id")


@query("file_rules_folder")
def _(v: Views):
    """The same rules over real files, measured by the reader, with the acceptance rate."""
    root = sinks.write_csv(_as_text(v), shared_dir(v.spark, "upload"), sep=";")
    return governance.file_stats(governance.file_verdicts(src.measure_files(v.spark, root)))
