"""Streaming queries: the tables are landed as files and the stream runs to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from callstrata.plans.fixtures import AS_OF_CALLS, Views
from callstrata.plans.q_insight import _RATE, _block_sql
from callstrata.plans.registry import query
from callstrata.session import shared_dir
from callstrata.streaming import jobs, limits


def _stream(v: Views, table, ts: str):
    path = jobs.land(table, shared_dir(v.spark, "landing"))
    return jobs.landed(v.spark, path, table.schema, ts)


_MAX = "(SELECT date_trunc('millisecond', max(FECHA)) FROM calls WHERE SENTIDO IS NOT NULL)"


@query("stream_daily", f"""SELECT date_trunc('day', FECHA)::TIMESTAMP AS desde, SENTIDO AS serie, count(TELEFONO) AS y, count(*) FILTER (WHERE ATENDIDA='Si') AS atendidas
  FROM calls WHERE SENTIDO IS NOT NULL AND date_trunc('day', FECHA)::TIMESTAMP + INTERVAL 1 DAY <= {_MAX} - INTERVAL 1 DAY GROUP BY 1,2""")
def _(v: Views):
    calls = v.calls.select("FECHA", "TELEFONO", "SENTIDO", "ATENDIDA")
    return jobs.run_to_table(jobs.daily_counts(_stream(v, calls, "FECHA")), shared_dir(v.spark, "daily")).withColumn(
        "desde", F.col("desde").cast("timestamp_ntz"))


@query("stream_late_future", f"""SELECT CAST(FECHA AS DATE) > DATE '{AS_OF_CALLS}' AS futura, count(*) AS filas, min(call_id) AS primera FROM calls GROUP BY 1""")
def _(v: Views):
    calls = v.calls.select("call_id", "FECHA")
    kept, future = jobs.split_future(_stream(v, calls, "FECHA"), AS_OF_CALLS, shared_dir(v.spark, "future"))
    part = lambda df, flag: df.agg(F.count(F.lit(1)).alias("filas"), F.min("call_id").alias("primera")).select(
        F.lit(flag).alias("futura"), "filas", "primera")
    return part(kept, False).unionByName(part(future, True))


_WIN = """SELECT s AS desde, s + INTERVAL 1 HOUR AS hasta, endpoint AS clave, count(*) AS n, count(*)>5 AS excede FROM
  (SELECT endpoint, time_bucket(INTERVAL 10 MINUTE, created_at) - k*INTERVAL 10 MINUTE AS s FROM api_calls, (VALUES (0),(1),(2),(3),(4),(5)) t(k))
  WHERE s + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(created_at)) FROM api_calls) - INTERVAL 10 MINUTE GROUP BY 1,2,3"""


def _windows(v: Views):
    log = v.api_calls.select("endpoint", "created_at")
    return jobs.sliding_counts(_stream(v, log, "created_at"), "endpoint", "created_at", limit=5)


@query("stream_sliding_rate", _WIN)
def _(v: Views):
    out = jobs.run_to_table(_windows(v), shared_dir(v.spark, "rate"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("desde", "hasta")})


@query("stream_block", f"""SELECT clave, desde, acumulado, CASE WHEN acumulado>=3 THEN CAST(15*pow(2, least(acumulado,5)) AS INTEGER) END AS minutos FROM
  (SELECT clave, desde, row_number() OVER (PARTITION BY clave ORDER BY desde) AS acumulado FROM ({_WIN}) WHERE excede)""")
def _(v: Views):
    return jobs.blocks(_windows(v), shared_dir(v.spark, "blocks")).withColumn("desde", F.col("desde").cast("timestamp_ntz"))


@query("stream_sessions", """SELECT inicio, cierre, clave, eventos FROM (SELECT user_id AS clave, min(ts) AS inicio, max(ts) + INTERVAL 30 MINUTE AS cierre, count(*) AS eventos
  FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
    <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM events)) GROUP BY user_id, g)
  WHERE cierre <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR""")
def _(v: Views):
    log = v.events.select("user_id", "ts")
    out = jobs.run_to_table(jobs.sessions(_stream(v, log, "ts"), "user_id", "ts"), shared_dir(v.spark, "sessions"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("inicio", "cierre")})


_CLOSED = "(s // 60 + 1) * 60 * 1000 <= (SELECT epoch_ms(max(created_at)) FROM api_calls) - 600000"


@query("stream_limits", f"""SELECT r.*, acumulado, minutos_bloqueo, hasta_s FROM ({_RATE}) r LEFT JOIN (SELECT clave, s, acumulado, minutos_bloqueo, hasta_s FROM ({_block_sql(10, 1, 5)})) b
  USING (clave, s) WHERE {_CLOSED}""")
def _(v: Views):
    """Trailing counts, violations and blocks by keyed state and timers, of the seconds that the watermark has passed."""
    log = v.api_calls.select("endpoint", "created_at")
    return limits.run(limits.limit_stream(_stream(v, log, "created_at"), "endpoint", "created_at", minute=1, hour=5), shared_dir(v.spark, "limits"))
