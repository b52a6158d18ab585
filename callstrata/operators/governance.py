"""Access, retention, file and text checks, request rates and activity sessions."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callstrata.functions.dates import epoch_second
from callstrata.schema import (
    BLOCK_AFTER, BLOCK_FACTOR, BLOCK_MAX_STEPS, BLOCK_MINUTES, BURST_LIMIT, BURST_SECONDS, FILE_BAD_CHARS,
    FILE_EXTENSIONS, FILE_MAX_BYTES, FILE_MIN_BYTES, FILE_NAME_MAX, FILE_RESERVED, GLOBAL_HOUR_LIMIT,
    GLOBAL_MINUTE_LIMIT, HOUR_LIMIT, LONG_PATH, LONG_PATH_MARK, MINUTE_LIMIT, SENSITIVE, SENSITIVE_MARK, SUSPICIOUS, TRACE_MARK,
    USER_HOUR_LIMIT, USER_MINUTE_LIMIT,
)


def visible_rows(df: DataFrame, users: DataFrame, me: int, owner: str = "user_id") -> DataFrame:
    """Own rows, or every row for an administrator (role in the JSON metadata)."""
    admin = users.where((F.col("id") == me) & (F.get_json_object("meta", "$.role") == "admin")).select(
        F.lit(True).alias("a")).limit(1).scalar()
    return df.where((F.col(owner) == me) | F.coalesce(admin, F.lit(False)))


def expired(rule: str, as_of: str) -> Column:
    """Whether a row may be deleted under a named retention rule."""
    now, made = F.lit(as_of).cast("timestamp_ntz"), F.col("created_at")
    if rule in ("activities", "logs"):
        return made < now - F.expr("INTERVAL 1 YEAR")
    if rule == "runs":
        return (made < now - F.expr("INTERVAL 6 MONTHS")) & F.col("status").isin("completed", "failed")
    if rule == "api_calls":
        return made < now - F.expr("INTERVAL 3 MONTHS")
    if rule == "storage":
        return F.col("expires_at") < now
    raise ValueError(f"unknown retention rule: {rule}")


def retention(df: DataFrame, rule: str, as_of: str) -> DataFrame:
    """Rows that stay."""
    return df.where(~F.coalesce(expired(rule, as_of), F.lit(False)))


def retention_report(df: DataFrame, rule: str, as_of: str) -> DataFrame:
    gone = F.coalesce(expired(rule, as_of), F.lit(False))
    return df.agg(F.count_if(~gone).alias("conservadas"), F.count_if(gone).alias("eliminadas")).select(
        F.lit(rule).alias("regla"), "conservadas", "eliminadas")


def with_expiry(sessions: DataFrame, days: int = 30) -> DataFrame:
    return sessions.withColumns({
        "status": F.coalesce("status", F.lit("created")),
        "expires_at": F.col("created_at") + F.make_dt_interval(F.lit(days))})


def scan_text(df: DataFrame, key: str, text: str, patterns=tuple(SUSPICIOUS)) -> DataFrame:
    """(key, patron) for every suspicious fragment in the whole text, ignoring case."""
    low = df.select(F.col(key), F.lower(text).alias("_t"))
    found = F.array_compact(F.array(*[F.when(F.col("_t").contains(p.lower()), p.lower()) for p in patterns]))
    return low.select(key, F.explode(found).alias("patron"))


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def sanitize(text: Column) -> Column:
    """Replace credentials, connection strings, paths, stack lines and versions; keep the first line.

    The patterns are applied one after the other. Each needs some fixed
    fragment, so a text is only searched for the patterns whose fragments it
    holds. The fragments are looked up in the folded original: a replacement
    cannot bring one in, as none contains a bracket and the marks hold none.
    """
    rules = [(f"(?iu){p}", SENSITIVE_MARK, need) for p, need in SENSITIVE]

    def held(folded: Column) -> Column:
        flags = []
        for _, _, need in rules:
            flag = F.contains(folded, F.lit(need[0]))
            for fragment in need[1:]:
                flag = flag & F.contains(folded, F.lit(fragment))
            flags.append(flag)
        return F.array(*flags)

    def step(prev: Column, flag: Column, pattern: str, mark: str) -> Column:
        return _with(prev, lambda t: F.when(flag, F.regexp_replace(t, pattern, mark)).otherwise(t))

    def chain(flags: Column) -> Column:
        out = text
        for i, (pattern, mark, _) in enumerate(rules):
            out = step(out, flags[i], pattern, mark)
        return F.regexp_replace(out, LONG_PATH, LONG_PATH_MARK)

    # The letters outside ASCII that a case-blind match takes for s, k and i.
    folded = F.lower(F.translate(text, "\u017f\u212a\u0130\u0131", "skii"))
    clean = _with(_with(folded, held), chain)
    first = lambda t: F.substring_index(t, "\n", 1)
    return _with(clean, lambda t: F.when(F.contains(t, F.lit("\n")), F.concat(first(t), F.lit(TRACE_MARK))).otherwise(t))


def file_verdicts(files: DataFrame, *keys: str) -> DataFrame:
    """(nombre, bytes, motivo): the first rule a file breaks, or null.

    ``files`` holds nombre, bytes, lineas, cabecera: measured per file by the source reader.
    """
    name, ext = F.col("nombre"), F.lower(F.regexp_extract("nombre", r"[^.](\.[^.]*)$", 1))
    stem = F.lower(F.regexp_replace("nombre", r"(?<=[^.])\.[^.]*$", ""))
    reason = (
        F.when(F.length(name) == 0, "nombre requerido")
        .when(F.length(name) > FILE_NAME_MAX, "nombre demasiado largo")
        .when(name.rlike(FILE_BAD_CHARS), "caracter no permitido")
        .when(stem.rlike(FILE_RESERVED), "nombre reservado")
        .when(name.startswith("."), "archivo oculto")
        .when(F.col("bytes") < FILE_MIN_BYTES, "demasiado pequeño")
        .when(F.col("bytes") > FILE_MAX_BYTES, "demasiado grande")
        .when((ext == "") | ~ext.isin(*FILE_EXTENSIONS), "tipo no permitido")
        .when((ext == ".csv") & (F.col("lineas") < 2), "menos de dos líneas")
        .when((ext == ".csv") & ~F.col("cabecera").rlike("[;,\t]"), "sin separador")
        .when((ext != ".csv") & (F.col("bytes") < 1000), "hoja corrupta"))
    return files.select(*keys, "nombre", "bytes", reason.alias("motivo"))


def file_stats(verdicts: DataFrame) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if(F.col("motivo").isNull())
    return verdicts.agg(n.alias("validados"), ok.alias("aceptados"), (n - ok).alias("rechazados"),
                        (ok * 100.0 / F.greatest(n, F.lit(1))).alias("tasa_exito"))


# --- request rates -----------------------------------------------------------------------------

def sliding_rate(requests: DataFrame, key: str, ts: str, burst: int | None = BURST_LIMIT, minute: int = MINUTE_LIMIT,
                 hour: int = HOUR_LIMIT) -> DataFrame:
    """Per key and second: requests in the trailing 10 s, 60 s and 3600 s, the limit broken first, and the requests over it.

    ``exceso`` counts the requests of the second that, taken one by one, found a
    limit already used up. Requests are counted per key and second before the
    shuffle. Each hour of a key is one window group that also receives the hour
    before it, so a group never holds more than 7200 rows however busy the key is.
    ``burst=None`` leaves the ten-second limit out.
    """
    sec = epoch_second(F.col(ts))
    seconds = requests.groupBy(F.col(key).alias("clave"), sec.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    own = F.floor(F.col("s") / 3600)
    spread = seconds.withColumn("h", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy("clave", "h").orderBy("s")

    def trailing(k):
        return F.sum("n").over(w.rangeBetween(-(k - 1), 0))

    counted = spread.withColumns({"n_10s": trailing(BURST_SECONDS), "n_60s": trailing(60), "n_3600s": trailing(3600)}).where(
        F.col("h") == own)
    over = [F.col("n_60s") - minute, F.col("n_3600s") - hour] + ([F.col("n_10s") - burst] if burst is not None else [])
    broken = F.when(F.col("n_60s") > minute, "minuto").when(F.col("n_3600s") > hour, "hora")
    if burst is not None:
        broken = F.when(F.col("n_10s") > burst, "rafaga").otherwise(broken)
    return counted.select("clave", "s", F.col("n").alias("n_1s"), "n_10s", "n_60s", "n_3600s", broken.alias("violacion"),
                          F.least(F.col("n"), F.greatest(F.lit(0), *over)).alias("exceso"))


def user_rate(requests: DataFrame, user: str, ts: str) -> DataFrame:
    """The trailing counts of signed-in users against their own limits, which know no burst."""
    return sliding_rate(requests.where(F.col(user).isNotNull()), user, ts, None, USER_MINUTE_LIMIT, USER_HOUR_LIMIT)


def global_rate(requests: DataFrame, ts: str, minute: int = GLOBAL_MINUTE_LIMIT, hour: int = GLOBAL_HOUR_LIMIT) -> DataFrame:
    """The trailing counts of all requests together; one row per second is all that is ordered."""
    return sliding_rate(requests.withColumn("_todo", F.lit("global")), "_todo", ts, None, minute, hour)


def top_violators(rates: DataFrame, n: int = 10) -> DataFrame:
    return rates.where(F.col("violacion").isNotNull()).groupBy("clave").agg(F.sum("exceso").alias("violaciones")).orderBy(
        F.desc("violaciones"), "clave").limit(n)


def escalating_block(rates: DataFrame) -> DataFrame:
    """Running violations of a key, one per request over a limit, and the block that a burst brings from the third on.

    The block lasts 15 min x 2^min(violations, 5). Requests are judged as they
    arrive, whether or not an earlier block should have kept them out;
    ``enforced`` takes the blocks into account. The running total is taken inside
    each hour and shifted by the total of the earlier hours, so one key's whole
    history is never one window group.
    """
    bad = rates.where(F.col("violacion").isNotNull()).withColumn("h", F.floor(F.col("s") / 3600))
    hours = bad.groupBy("clave", "h").agg(F.sum("exceso").alias("_t"))
    before = Window.partitionBy("clave").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    offset = hours.select("clave", "h", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_antes"))
    inside = F.sum("exceso").over(Window.partitionBy("clave", "h").orderBy("s"))
    out = bad.withColumn("_dentro", inside).join(offset, ["clave", "h"]).withColumn(
        "acumulado", F.col("_dentro") + F.col("_antes"))
    minutes = BLOCK_MINUTES * F.pow(F.lit(BLOCK_FACTOR), F.least(F.col("acumulado"), F.lit(BLOCK_MAX_STEPS)))
    blocked = (F.col("violacion") == "rafaga") & (F.col("acumulado") >= BLOCK_AFTER)
    return out.select("clave", "s", "violacion", "exceso", "acumulado", F.when(blocked, minutes.cast("int")).alias("minutos_bloqueo"),
                      F.when(blocked, F.col("s") + minutes.cast("long") * 60).alias("hasta_s"))


class Gate:
    """The limits of one key, second after second: what the last 10, 60 and 3600 seconds let through, violations so far, and the end of a block."""

    def __init__(self, burst: int | None, minute: int, hour: int, past=(), total: int = 0, until: int = 0):
        self.limits = [("rafaga", burst, BURST_SECONDS), ("minuto", minute, 60), ("hora", hour, 3600)]
        self.total, self.until = total, until
        self.windows: list[deque] = [deque() for _ in self.limits]
        self.sums = [0] * len(self.limits)
        for s, n in past:
            self._add(s, n)

    def _add(self, s: int, n: int) -> None:
        for k, window in enumerate(self.windows):
            window.append((s, n))
            self.sums[k] += n

    def forget(self, s: int) -> None:
        """Drop what lies outside the windows that end at second ``s``."""
        for k, (_, _, width) in enumerate(self.limits):
            window = self.windows[k]
            while window and window[0][0] <= s - width:
                self.sums[k] -= window.popleft()[1]

    def kept(self) -> list[tuple[int, int]]:
        return list(self.windows[-1])

    def _minutes(self, kind: str) -> int | None:
        return BLOCK_MINUTES * BLOCK_FACTOR ** min(self.total, BLOCK_MAX_STEPS) if kind == "rafaga" and self.total >= BLOCK_AFTER else None

    def counted(self, s: int, n: int) -> tuple:
        """All requests of a second, blocked or not: (s, n, the trailing counts, limit broken first, requests over it, running violations, minutes, end)."""
        self.forget(s)
        self._add(s, n)
        over = [c - limit for c, (_, limit, _) in zip(self.sums, self.limits, strict=True) if limit is not None]
        excess = min(n, max(0, *over))
        kind = next((name for c, (name, limit, _) in zip(self.sums, self.limits, strict=True) if limit is not None and c > limit), None)
        self.total += excess
        minutes = self._minutes(kind) if kind else None
        end = s + 60 * minutes if minutes else None
        self.until = max(self.until, end or 0)
        return s, n, *self.sums, kind, excess, self.total if kind else None, minutes, end

    def enforced(self, s: int, n: int) -> list[tuple]:
        """A row per violation of the requests that a block lets through: (s, limit, running violations, minutes, end). A second stops where its block begins."""
        out: list[tuple] = []
        if s < self.until:
            return out
        self.forget(s)
        let = 0
        while let < n and s >= self.until:
            room = min(limit - c for c, (_, limit, _) in zip(self.sums, self.limits, strict=True) if limit is not None) - let
            if room > 0:
                let += min(room, n - let)
                continue
            let += 1
            self.total += 1
            kind = next(name for c, (name, limit, _) in zip(self.sums, self.limits, strict=True) if limit is not None and c + let > limit)
            minutes = self._minutes(kind)
            self.until = s + 60 * minutes if minutes else self.until
            out.append((s, kind, self.total, minutes, self.until if minutes else None))
        self._add(s, let)
        return out


def limited(requests: DataFrame, key: str, limits: DataFrame | None, burst: int | None = BURST_LIMIT, minute: int = MINUTE_LIMIT, hour: int = HOUR_LIMIT) -> DataFrame:
    """Requests with ``clave`` (text) and the limits of their key: its own where ``limits`` (clave, burst, minute, hour) has them, else those given."""
    rows = requests.withColumn("clave", F.col(key).cast("string"))
    usual = {"burst": F.lit(burst).cast("long"), "minute": F.lit(minute).cast("long"), "hour": F.lit(hour).cast("long")}
    if limits is None:
        return rows.withColumns(usual)
    own = limits.select("clave", *[F.col(c).cast("long").alias(f"_{c}") for c in usual], F.lit(True).alias("_own"))
    return rows.join(own, "clave", "left").withColumns({c: F.when(F.col("_own"), F.col(f"_{c}")).otherwise(v) for c, v in usual.items()}).drop("_own", *[f"_{c}" for c in usual])


def enforced(requests: DataFrame, key: str, ts: str, burst: int | None = BURST_LIMIT, minute: int = MINUTE_LIMIT, hour: int = HOUR_LIMIT,
             limits: DataFrame | None = None) -> DataFrame:
    """(clave, s, violacion, acumulado, minutos_bloqueo, hasta_s): a row per violation of requests that pass the blocks.

    A blocked key's requests count no more until the block ends, so what is
    counted depends on every earlier block of the key. The seconds of a key lie
    next to each other in a partition, in order, and are read as a stream that
    remembers one hour of counts. ``limits`` names keys with limits of their own.
    """
    known = limited(requests.where(F.col(key).isNotNull()), key, limits, burst, minute, hour)
    seconds = known.groupBy("clave", epoch_second(F.col(ts)).alias("s")).agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("burst", "minute", "hour")])

    def judge(batches):
        clave, gate = None, None
        for pdf in batches:
            out = []
            for k, s, n, *given in zip(*(pdf[c] for c in ("clave", "s", "n", "burst", "minute", "hour")), strict=True):
                if k != clave:
                    clave, gate = k, Gate(*(None if pd.isna(x) else int(x) for x in given))
                out += [(k, *row) for row in gate.enforced(int(s), int(n))]
            frame = pd.DataFrame(out, columns=["clave", "s", "violacion", "acumulado", "minutos_bloqueo", "hasta_s"])
            yield frame.astype({"minutos_bloqueo": "Int32", "hasta_s": "Int64", "s": "int64", "acumulado": "int64"})

    ordered = seconds.repartition("clave").sortWithinPartitions("clave", "s")
    return ordered.mapInPandas(judge, "clave string, s bigint, violacion string, acumulado bigint, minutos_bloqueo int, hasta_s bigint")


def activity_sessions(events: DataFrame, key: str, ts: str, gap_minutes: int = 30) -> DataFrame:
    """Runs of activity with no pause longer than the gap.

    Events in one tumbling slot of the gap's length are always in the same run,
    so each (key, slot) shrinks to its first and last time before the runs are
    built: a key contributes at most one row per slot to its window group.
    """
    gap = gap_minutes * 60
    sec = epoch_second(F.col(ts))
    slots = events.groupBy(F.col(key).alias("clave"), F.floor(sec / gap).alias("_slot")).agg(
        F.min(ts).alias("_a"), F.max(ts).alias("_b"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("clave").orderBy("_slot")
    pause = F.timestamp_diff("MICROSECOND", F.lag("_b").over(w), F.col("_a")) > gap * 1_000_000
    run = F.sum(F.col("_new")).over(w)
    return slots.withColumn("_new", F.coalesce(pause, F.lit(True)).cast("int")).withColumn("sesion", run).groupBy(
        "clave", "sesion").agg(F.min("_a").alias("inicio"), F.max("_b").alias("fin"), F.sum("_n").alias("eventos"))
