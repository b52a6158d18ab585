"""Users, roles and holidays: distributions, attendance and per-user productivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callstrata.functions.joins import salted_left_join
from callstrata.functions.stats import arg_max, arg_min, pct
from callstrata.schema import DAY_LABOUR, DAY_LONG, DAY_POST, DAY_PRE, DAY_WEEKEND, DEFAULT_ROLE, HOLIDAY_KEYWORDS, HOLIDAY_OTHER

# Day-type labels in column order for the pivoted tables.
DAY_TYPES = [DAY_LABOUR, DAY_WEEKEND, DAY_LONG, DAY_PRE, DAY_POST] + [
    f"Feriado ({c})" for c in [k for k, _ in HOLIDAY_KEYWORDS] + [HOLIDAY_OTHER, "Normal"]]
DAY_TYPE_COLS = {
    DAY_LABOUR: "laboral", DAY_WEEKEND: "fin_semana", DAY_LONG: "fin_semana_largo", DAY_PRE: "pre", DAY_POST: "post",
}


def _day_class(c):
    """Short column name of a day type; all holidays share one."""
    out = F.when(c.startswith("Feriado"), "feriado")
    for label, name in DAY_TYPE_COLS.items():
        out = out.when(c == label, name)
    return out


def counted(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls as counts ``n`` per day, hour and the given columns, combined before the shuffle.

    What follows marks and compares a few rows per day instead of every call;
    the operators below take such counts as well as single rows.
    """
    return calls.groupBy(F.to_date("FECHA").alias("ds"), F.hour("FECHA").alias("hora"), *keys).agg(F.count(F.lit(1)).alias("n"))


def _rows(df: DataFrame):
    return F.sum("n") if "n" in df.columns else F.count(F.lit(1))


def _rows_if(df: DataFrame, test):
    return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)) if "n" in df.columns else F.count_if(test)


def day_types(marked: DataFrame) -> DataFrame:
    """Calls per day type with their share."""
    per = marked.groupBy("tipo_dia").agg(_rows(marked).alias("llamadas"))
    every = Window.partitionBy(F.lit(1))  # a dozen rows
    return per.withColumn("pct", pct(F.col("llamadas"), F.sum("llamadas").over(every)))


def holiday_totals(marked: DataFrame) -> DataFrame:
    """Calls on, before and after holidays and their shares."""
    n = _rows(marked)
    parts = {"feriado": "es_feriado", "pre": "pre_feriado", "post": "post_feriado"}
    return marked.agg(n.alias("total"), *[_rows_if(marked, F.col(c)).alias(f"n_{k}") for k, c in parts.items()],
                      *[pct(_rows_if(marked, F.col(c)), n).alias(f"pct_{k}") for k, c in parts.items()])


def attendance_by_day_type(marked: DataFrame) -> DataFrame:
    """Answered and missed calls and attendance rate per day type."""
    a = F.col("ATENDIDA")
    return marked.groupBy("tipo_dia").agg(_rows_if(marked, a == "Si").alias("si"), _rows_if(marked, a == "No").alias("no")).withColumn(
        "tasa_atencion", pct(F.col("si"), F.col("si") + F.col("no")))


def by_category(marked: DataFrame) -> DataFrame:
    return marked.where("es_feriado").groupBy("feriado_categoria").agg(_rows(marked).alias("llamadas"))


def holiday_hours(marked: DataFrame) -> DataFrame:
    """Holiday flag x hour counts."""
    hour = F.col("hora") if "hora" in marked.columns else F.hour("FECHA")
    return marked.groupBy("es_feriado").agg(*[_rows_if(marked, hour == h).alias(f"h{h:02d}") for h in range(24)])


def holiday_metrics(marked: DataFrame) -> DataFrame:
    """Mean calls per working day, holiday and day before a holiday, with the change in percent.

    Counted per day first, so the distinct-day counts work on one row per date.
    """
    days = marked.groupBy("ds").agg(
        _rows(marked).alias("n"), F.first("es_feriado").alias("f"), F.first("pre_feriado").alias("p"),
        (F.first("tipo_dia") == DAY_LABOUR).alias("l"))
    n = F.col("n")

    def mean(flag):
        return F.coalesce(F.sum(F.when(F.col(flag), n)), F.lit(0)) / F.greatest(F.count_if(F.col(flag)), F.lit(1))

    out = days.agg(F.sum(n).alias("total_llamadas"), F.coalesce(F.sum(F.when(F.col("f"), n)), F.lit(0)).alias(
        "llamadas_feriados"), mean("l").alias("promedio_normal"), mean("f").alias("promedio_feriado"),
        mean("p").alias("promedio_pre_feriado"))
    base = F.col("promedio_normal")
    return out.withColumns({
        "pct_feriados": pct(F.col("llamadas_feriados"), F.col("total_llamadas")),
        "variacion_feriado_pct": F.coalesce(pct(F.col("promedio_feriado") - base, base), F.lit(0.0)),
        "variacion_pre_feriado_pct": F.coalesce(pct(F.col("promedio_pre_feriado") - base, base), F.lit(0.0))})


def impact_class(metrics: DataFrame) -> DataFrame:
    """Demand on holidays: higher, lower or stable."""
    v = F.col("variacion_feriado_pct")
    return metrics.select("variacion_feriado_pct", F.when(v > 10, "mayor_demanda").when(v < -10, "menor_demanda")
                          .otherwise("demanda_estable").alias("impacto"))


def top_holidays(marked: DataFrame, n: int = 5) -> DataFrame:
    return marked.where("es_feriado").groupBy("ds", "feriado_descripcion").agg(
        _rows(marked).alias("llamadas")).orderBy(F.desc("llamadas"), "ds").limit(n)


def role_holiday_share(marked: DataFrame) -> DataFrame:
    """Calls, holiday calls and holiday share per role in one pass."""
    n, on = _rows(marked), _rows_if(marked, F.col("es_feriado"))
    return marked.groupBy("CARGO").agg(n.alias("total_llamadas"), on.alias("llamadas_feriados"), pct(on, n).alias("porcentaje_feriados"))


def role_daytype(marked: DataFrame) -> DataFrame:
    """Share of each day type within a role, as columns."""
    kind = _day_class(F.col("tipo_dia"))
    n = _rows(marked)
    return marked.groupBy("CARGO").agg(*[
        pct(_rows_if(marked, kind == c), n).alias(c) for c in [*DAY_TYPE_COLS.values(), "feriado"]])


def role_attendance(marked: DataFrame) -> DataFrame:
    """Attendance rate and calls per role and day type, as columns."""
    kind = _day_class(F.col("tipo_dia"))
    aggs = []
    for c in [*DAY_TYPE_COLS.values(), "feriado"]:
        aggs += [pct(_rows_if(marked, (kind == c) & (F.col("ATENDIDA") == "Si")), _rows_if(marked, kind == c)).alias(f"tasa_{c}"),
                 _rows_if(marked, kind == c).alias(f"n_{c}")]
    return marked.groupBy("CARGO").agg(*aggs)


def role_extremes(share: DataFrame) -> DataFrame:
    """Roles with the largest and smallest holiday share."""
    return share.agg(arg_max("CARGO", "porcentaje_feriados").alias("mas_afectado"),
                     F.max("porcentaje_feriados").alias("pct_max"),
                     arg_min("CARGO", "porcentaje_feriados").alias("menos_afectado"),
                     F.min("porcentaje_feriados").alias("pct_min"), F.count(F.lit(1)).alias("cargos"))


def role_distribution(users: DataFrame) -> DataFrame:
    """Users per role, share, number of roles and rank."""
    per = users.groupBy("CARGO").agg(F.count(F.lit(1)).alias("usuarios"))
    every = Window.partitionBy(F.lit(1))  # one row per role
    return per.withColumns({
        "pct": pct(F.col("usuarios"), F.sum("usuarios").over(every)),
        "cargos": F.count(F.lit(1)).over(every),
        "puesto": F.row_number().over(every.orderBy(F.desc("usuarios"), "CARGO"))})


def attach_role(calls: DataFrame, users: DataFrame, default_role: str = DEFAULT_ROLE) -> DataFrame:
    """Role of the caller's phone on every call; unknown phones get the default.

    The user list grows with the data, so it is not broadcast; hot and null
    phones are spread by a salt taken from the call id.
    """
    dim = users.groupBy("TELEFONO").agg(F.min("CARGO").alias("cargo_usuario"))
    return salted_left_join(calls, dim, "TELEFONO", "call_id").withColumn(
        "cargo_usuario", F.coalesce("cargo_usuario", F.lit(default_role)))


def calls_by_user(calls: DataFrame, users: DataFrame) -> DataFrame:
    """Per user: calls, days, calls per day, attendance and mean duration.

    Every user has a row, with zero calls if there were none. A phone that
    several users list belongs to the smallest name. Calls of phones that nobody
    lists, or without a phone, are one row with a null user. Calls are first
    reduced to one row per phone and day, so a phone with a third of all calls is
    a few rows in the join.
    """
    per_day = calls.groupBy("TELEFONO", F.to_date("FECHA").alias("ds")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ATENDIDA") == "Si").alias("a"),
        F.sum("DURACION").alias("d"), F.count("DURACION").alias("nd"))
    owners = users.where(F.col("TELEFONO").isNotNull()).groupBy("TELEFONO").agg(F.min("USUARIO").alias("USUARIO"))
    owned = per_day.join(owners, "TELEFONO", "left").groupBy("USUARIO", "ds").agg(*[F.sum(c).alias(c) for c in ("n", "a", "d", "nd")])
    per_user = owned.groupBy("USUARIO").agg(
        F.sum("n").alias("llamadas"), F.count(F.lit(1)).alias("dias"), F.sum("a").alias("a"),
        F.sum("d").alias("d"), F.sum("nd").alias("nd"))
    roles = users.groupBy("USUARIO").agg(F.min("CARGO").alias("CARGO"))
    joined = roles.where(F.col("USUARIO").isNotNull()).join(per_user, "USUARIO", "full")
    calls_, days = F.coalesce("llamadas", F.lit(0)), F.coalesce("dias", F.lit(0))
    return joined.select(
        "USUARIO", "CARGO", calls_.alias("llamadas"), days.alias("dias"),
        F.try_divide(F.col("llamadas"), F.col("dias")).alias("llamadas_por_dia"),
        F.try_divide(F.col("a") * 100.0, F.col("llamadas")).alias("tasa_atencion"),
        F.try_divide(F.col("d").cast("double"), F.col("nd")).alias("duracion_media"))


def rank_users(by_user: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` busiest ranks of users in each role; equal counts share a rank."""
    w = Window.partitionBy("CARGO").orderBy(F.desc("llamadas"))
    return by_user.where(F.col("USUARIO").isNotNull()).withColumn("puesto", F.dense_rank().over(w)).where(F.col("puesto") <= n)
