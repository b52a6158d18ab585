"""Alerts and recommendations derived from forecasts, audits and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callstrata.functions.numbering import disorder
from callstrata.functions.stats import pct
from callstrata.messages import TEXT
from callstrata.operators.insight import temporal_gaps

SEVERITY = {"CRITICA": 0, "ALTA": 1, "MEDIA": 2, "BAJA": 3}


def _fmt(spec: str, *cols: Column) -> Column:
    """Formatted text; null when a value is null."""
    known = cols[0].isNotNull()
    for c in cols[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.format_string(spec, *cols))


def _one(c: Column) -> Column:
    """One decimal, halves to the even digit."""
    return F.bround(c, 1)


def _alert(tipo, severidad, valor, umbral, incert, mensaje, accion, confianza) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(tipo).alias("tipo"), lit(severidad).alias("severidad"), F.col("ds").alias("fecha"),
        lit(valor).cast("double").alias("valor_predicho"), lit(umbral).cast("double").alias("umbral"),
        lit(incert).cast("double").alias("incertidumbre"), lit(mensaje).alias("mensaje"),
        lit(accion).alias("accion"), lit(confianza).cast("double").alias("confianza"))


def demand_alerts(fc: DataFrame, daily: DataFrame) -> DataFrame:
    """Extreme, high and low demand, wide spread, heavy Mondays and a rising tail.

    The history is one statistics row per series; every forecast row then
    yields its alerts from one expression.
    """
    stats = daily.groupBy("serie").agg(F.avg("y").alias("_m"), F.stddev_samp("y").alias("_s"))
    y, u, m, s = F.col("yhat_ensemble"), F.col("yhat_std"), F.col("_m"), F.col("_s")
    crit, high, low = m + 2.5 * s, m + 1.5 * s, m - 1.5 * s

    def sure(cap, size=y):
        return F.when(size != 0 if size is not y else y > 0, F.least(F.lit(cap), 1 - F.try_divide(u, size))).otherwise(0.5)

    demand = (
        F.when(y > crit, _alert(
            "DEMANDA_EXTREMA", "CRITICA", _one(y), _one(crit), None,
            _fmt(TEXT["demanda_extrema_predicha_llamadas"], _one(y)),
            TEXT["activar_protocolo_emergencia_personal"], sure(0.95)))
        .when(y > high, _alert(
            "DEMANDA_ALTA", "ALTA", _one(y), _one(high), None,
            _fmt(TEXT["alta_demanda_predicha_llamadas"], _one(y)),
            TEXT["programar_personal_adicional_revisar"], sure(0.9)))
        .when(y < low, _alert(
            "DEMANDA_BAJA", "MEDIA", _one(y), _one(low), None,
            _fmt(TEXT["baja_demanda_predicha_llamadas"], _one(y)),
            TEXT["considerar_reducir_turnos_o"], sure(0.85, F.abs(y)))))
    wide = F.when(u > y * 0.3, _alert(
        "ALTA_INCERTIDUMBRE", "MEDIA", _one(y), None, _one(u),
        _fmt(TEXT["alta_incertidumbre_llamadas_prediccion"], _one(u),
             F.coalesce(_fmt("%.1f", _one(F.try_divide(u, y) * 100)), F.lit("-"))),
        TEXT["monitorear_cerca_mantener_personal"], 0.6))
    monday = F.when((F.weekday("ds") == 0) & (y > m * 1.3), _alert(
        "LUNES_ALTO", "ALTA", _one(y), None, None,
        _fmt(TEXT["lunes_demanda_alta_llamadas"], _one(y)),
        TEXT["reforzar_equipo_lunes_preparar"], 0.8))
    rise = F.when(F.col("_rising"), _alert(
        "TENDENCIA_CRECIENTE", "MEDIA", None, None, None, TEXT["tendencia_creciente_sostenida_proximos"],
        TEXT["revisar_capacidad_siguiente_semana"], 0.75))
    tail = rising_tail(fc).select("serie", F.col("hasta").alias("ds"), F.col("creciente").alias("_rising"))
    return fc.join(stats, "serie").join(tail, ["serie", "ds"], "left").select(
        "serie", F.inline(F.array_compact(F.array(demand, wide, monday, rise))))


def rising_tail(fc: DataFrame, n: int = 5) -> DataFrame:
    """Whether the last ``n`` predictions of a series rise strictly."""
    w = Window.partitionBy("serie")
    step = fc.withColumns({
        "_r": F.row_number().over(w.orderBy(F.desc("ds"))),
        "_up": F.col("yhat_ensemble") > F.lag("yhat_ensemble").over(w.orderBy("ds"))})
    return step.where(F.col("_r") <= n).groupBy("serie").agg(
        F.max("ds").alias("hasta"),
        (F.bool_and(F.when(F.col("_r") < n, F.col("_up")).otherwise(True)) & (F.count(F.lit(1)) == n)).alias("creciente"))


def severity_rank(c: Column) -> Column:
    out = None
    for name, rank in SEVERITY.items():
        out = F.when(c == name, rank) if out is None else out.when(c == name, rank)
    return out.otherwise(4)


def sort_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts by severity, then date, with their position."""
    return alerts.withColumn("orden", severity_rank(F.col("severidad"))).orderBy("orden", "fecha", "serie", "tipo")


def _rules(df: DataFrame, *rules: tuple) -> DataFrame:
    """One row per rule that holds: (condition, struct) pairs over the columns of ``df``."""
    return df.select(F.inline(F.array_compact(F.array(*[F.when(cond, row) for cond, row in rules]))))


def _rec(tipo: str, prioridad: str, problema: Column | str, solucion: str) -> Column:
    p = problema if isinstance(problema, Column) else F.lit(problema)
    return F.struct(F.lit(tipo).alias("tipo"), F.lit(prioridad).alias("prioridad"), p.alias("problema"),
                    F.lit(solucion).alias("solucion"))


def audit_recommendations(metrics: DataFrame) -> DataFrame:
    """Rules over (score_promedio, coef_variacion, atipicos, variabilidad_horaria)."""
    return _rules(
        metrics,
        (F.col("score_promedio") < 80, _rec(
            "CALIDAD_DATOS", "ALTA", _fmt(TEXT["calidad_datos_baja"], _one(F.col("score_promedio"))),
            TEXT["implementar_validacion_datos_origen"])),
        (F.col("coef_variacion") > 0.5, _rec(
            "VARIABILIDAD", "ALTA", _fmt(TEXT["alta_variabilidad_diaria"], F.bround("coef_variacion", 3)),
            TEXT["usar_modelos_que_manejen"])),
        (F.col("atipicos") > 5, _rec(
            "OUTLIERS", "MEDIA", TEXT["multiples_dias_volumenes_atipicos"],
            TEXT["implementar_deteccion_tratamiento_automatico"])),
        (F.col("variabilidad_horaria") > 0.8, _rec(
            "ESTACIONALIDAD", "ALTA", TEXT["fuerte_patron_horario_no"],
            TEXT["agregar_regresores_horarios_usar"])))


def segment_recommendations(seg: DataFrame) -> DataFrame:
    """Rules over the segmented log: undetermined share, balance and mean confidence."""
    kinds = seg.groupBy("tipo_llamada").agg(F.count(F.lit(1)).alias("n"), F.sum("confianza_segmentacion").alias("c"))
    t = F.col("tipo_llamada")

    def count_of(name):
        return F.coalesce(F.sum(F.when(t == name, F.col("n"))), F.lit(0))

    m = kinds.agg(
        pct(count_of("INDETERMINADA"), F.sum("n")).alias("indet"),
        (count_of("ENTRANTE") / F.greatest(F.lit(1), F.coalesce(F.sum(F.when(t == "SALIENTE", F.col("n"))), F.lit(1)))
         ).alias("ratio"),
        F.count(F.lit(1)).alias("tipos"), (F.sum("c") / F.sum("n")).alias("conf"))
    return _rules(
        m,
        (F.col("indet") > 20, _rec("SEGMENTACION", "ALTA", _fmt(TEXT["llamadas_sin_clasificar"], _one(F.col("indet"))),
                                   TEXT["revisar_campos_adicionales_origen"])),
        ((F.col("tipos") >= 2) & ((F.col("ratio") > 5) | (F.col("ratio") < 0.2)), _rec(
            "BALANCE", "MEDIA", _fmt(TEXT["desbalance_entre_tipos_ratio"], _one(F.col("ratio"))),
            TEXT["crear_modelos_separados_cada"])),
        (F.col("conf") < 0.7, _rec(
            "CONFIANZA", "ALTA", _fmt(TEXT["confianza_segmentacion_baja"], F.bround("conf", 2)),
            TEXT["validar_manualmente_una_muestra"])))


def role_recommendations(share: DataFrame) -> DataFrame:
    """Advice per role from its holiday share, volume and name, numbered in order."""
    p, n, low = F.col("porcentaje_feriados"), F.col("total_llamadas"), F.lower("CARGO")
    busy, calm = p > 20, p < 5
    some = ~busy & ~calm
    big = n > F.col("_mediana")
    lead = low.contains("supervisor") | low.contains("jefe")
    agent = ~lead & (low.contains("agente") | low.contains("call center"))
    clerk = ~lead & ~agent & low.contains("secretaria")
    lines = [
        (busy, _fmt(TEXT["alto_volumen_feriados_programar"], _one(p))),
        (busy, TEXT["considerar_incentivos_especiales_feriados"]),
        (busy, TEXT["monitorear_cerca_calidad_servicio"]),
        (calm, _fmt(TEXT["baja_actividad_feriados_oportunidad"], _one(p))),
        (calm, TEXT["ideal_mantenimiento_sistemas"]),
        (calm, TEXT["programar_entrenamientos_especializados"]),
        (some, _fmt(TEXT["actividad_moderada_feriados_mantener"], _one(p))),
        (some, TEXT["monitorear_tendencias_estacionales"]),
        (big, TEXT["cargo_alto_volumen_priorizar"]),
        (big, TEXT["implementar_metricas_especificas_performance"]),
        (lead, TEXT["rol_liderazgo_coordinar_equipos"]),
        (lead, TEXT["planificar_horarios_especiales"]),
        (agent, TEXT["personal_operativo_evaluar_rotacion"]),
        (agent, TEXT["considerar_turnos_flexibles"]),
        (clerk, TEXT["soporte_administrativo_backup_feriados"]),
    ]
    every = Window.partitionBy(F.lit(1))  # one row per role
    texts = F.array_compact(F.array(*[F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in lines]))
    return share.withColumn("_mediana", F.median("total_llamadas").over(every)).select(
        "CARGO", F.posexplode(texts).alias("orden", "recomendacion"))


def validation_alerts(raw: DataFrame, daily: DataFrame, as_of: str, seq: str = "call_id") -> DataFrame:
    """Findings with their counts: invalid dates, an empty log, future rows, disorder, gaps.

    ``raw`` carries FECHA, null where the text could not be read.
    """
    found = lambda name, n: F.struct(F.lit(name).alias("hallazgo"), n.cast("long").alias("n"))
    dated = F.count("FECHA")
    basic = raw.agg(
        (F.count(F.lit(1)) - dated).alias("_bad"), F.when(dated == 0, 1).otherwise(0).alias("_none"),
        F.count_if(F.to_date("FECHA") > F.lit(as_of).cast("date")).alias("_late")).select(F.inline(F.array(
            found("fechas_invalidas", F.col("_bad")), found("sin_datos", F.col("_none")),
            found("fechas_futuras", F.col("_late")))))
    order = disorder(raw, seq, "FECHA").select(F.inline(F.array(found("filas_desordenadas", F.col("retrocesos")))))
    gaps = temporal_gaps(daily).agg(F.count(F.lit(1)).alias("_g")).select(F.inline(F.array(found("brechas", F.col("_g")))))
    return basic.unionByName(order).unionByName(gaps).where(F.col("n") > 0)
