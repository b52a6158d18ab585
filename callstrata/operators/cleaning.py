"""Row-level filters and derivations over the call log and daily series."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callstrata.functions import fingerprints
from callstrata.functions.dates import is_business, parse_call_time


def parse_calls(raw: DataFrame, text_col: str = "FECHA_TXT") -> DataFrame:
    """Parse the text date into FECHA and drop the rows where that fails."""
    return raw.withColumn("FECHA", parse_call_time(F.col(text_col))).where(F.col("FECHA").isNotNull())


def parse_report(raw: DataFrame, text_col: str = "FECHA_TXT") -> DataFrame:
    """Total, valid and invalid date counts in one pass."""
    t = parse_call_time(F.col(text_col))
    return raw.agg(F.count(F.lit(1)).alias("total"), F.count(t).alias("validas"),
                   F.count_if(t.isNull()).alias("invalidas"))


def derive_calls(calls: DataFrame) -> DataFrame:
    """Add date, hour, weekday name, month and year."""
    return calls.withColumns({
        "fecha_solo": F.to_date("FECHA"), "hora": F.hour("FECHA"), "dia_semana": F.date_format("FECHA", "EEEE"),
        "mes": F.month("FECHA"), "anio": F.year("FECHA"),
    })


def drop_future(df: DataFrame, as_of: str, col: str = "FECHA") -> DataFrame:
    """Keep rows up to the end of ``as_of``; the bound is on the raw column so that it reaches the scan."""
    return df.where(F.col(col) < F.date_add(F.lit(as_of).cast("date"), 1).cast("timestamp_ntz"))


def future_report(df: DataFrame, as_of: str, col: str = "FECHA") -> DataFrame:
    """Rows kept, rows in the future, and the cut-off date = min(last date, today)."""
    day, today = F.to_date(col), F.lit(as_of).cast("date")
    return df.agg(F.count_if(day <= today).alias("conservadas"), F.count_if(day > today).alias("futuras"),
                  F.least(F.max(day), today).alias("fecha_corte"))


def weekdays(df: DataFrame, col: str) -> DataFrame:
    return df.where(is_business(F.col(col)))


def by_direction(calls: DataFrame, tipo: str) -> DataFrame:
    return calls.where(F.col("SENTIDO") == tipo)


def hash_split(calls: DataFrame, key: str, share: float = 0.6) -> DataFrame:
    """Give rows without a direction a stable one: the given share 'in', the rest 'out'. The hash is one that every engine has."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % 10_000
    return calls.withColumn("SENTIDO", F.when(bucket < int(share * 10_000), "in").otherwise("out"))


def anti_remainder(all_rows: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``part``."""
    return all_rows.join(part.select(key), key, "left_anti")


def _all_null(cols: list[str]) -> Column:
    return functools.reduce(operator.and_, [F.col(c).isNull() for c in cols])


def clean_rows(df: DataFrame) -> DataFrame:
    """Drop rows that are null throughout, then exact duplicates; whole rows are shuffled only where their fingerprint repeats."""
    return fingerprints.distinct_rows(df.dropna(how="all"))


def clean_report(df: DataFrame) -> DataFrame:
    """Row counts before, after dropping null rows, and after dropping duplicates."""
    some = ~_all_null(df.columns)
    total = df.agg(F.count(F.lit(1)).alias("filas_iniciales"))
    left = fingerprints.count_rows(df.where(some))
    return total.withColumn("_k", F.lit(1)).join(left.withColumn("_k", F.lit(1)), "_k").select(
        "filas_iniciales", F.col("filas").alias("filas_sin_nulos"), F.col("distintas").alias("filas_finales"))


def training_cutoff(daily: DataFrame, cutoff: str, as_of: str) -> DataFrame:
    """History up to the smaller of the cut-off and today."""
    return daily.where(F.col("ds") <= F.lit(min(cutoff, as_of)).cast("date"))


def min_rows(daily: DataFrame, n: int = 30, by: str = "serie") -> DataFrame:
    """Series with at least ``n`` rows."""
    total = F.count(F.lit(1)).over(Window.partitionBy(by))
    return daily.withColumn("n_filas", total).where(F.col("n_filas") >= n)


def last_days(daily: DataFrame, n: int | None, by: str = "serie") -> DataFrame:
    """The last ``n`` days of each series; None keeps all."""
    if n is None:
        return daily
    top = F.max("ds").over(Window.partitionBy(by))
    return daily.withColumn("_top", top).where(F.col("ds") > F.date_sub("_top", n)).drop("_top")


def clip_non_negative(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.greatest(F.lit(0.0), F.col(c)) for c in cols})


def search_users(users: DataFrame, cargo: str | None = None, text: str | None = None) -> DataFrame:
    """Users of one role whose name contains a text, ignoring case."""
    if cargo:
        users = users.where(F.col("CARGO") == cargo)
    if text:
        users = users.where(F.lower("USUARIO").contains(text.lower()))
    return users


def read_range(df: DataFrame, col: str, as_of: str, days: int = 30) -> DataFrame:
    """Rows dated in the ``days`` before ``as_of``, both ends included; plain comparisons reach the scan."""
    end = F.lit(as_of).cast("date")
    lo, hi = F.date_sub(end, days).cast("timestamp_ntz"), F.date_add(end, 1).cast("timestamp_ntz")
    return df.where((F.col(col) >= lo) & (F.col(col) < hi))
