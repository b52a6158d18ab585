"""Request limits over a stream: trailing counts of 10, 60 and 3600 seconds and the blocks that follow, with keyed state and timers.

Requests wait per key and second until the watermark passes the end of their slot; then a timer reads all seconds that are due in
order, so the result does not depend on the order of arrival. What a key keeps is its last hour of counts, the seconds
that wait (lists per day, a new one whenever ``HELD`` seconds have been read), its violations and the end of its block. Python holds
one day of a key and ``ROWS`` rows to return at a time, however many days and requests are due. A key has one timer at a time: for its next slot, else for the
end of its block or of its last hour, after which a key without violations keeps nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callstrata.operators.governance import Gate, limited
from callstrata.schema import BURST_LIMIT, HOUR_LIMIT, MINUTE_LIMIT
from callstrata.streaming import jobs

#: Seconds that are read together once the watermark has passed them.
SLOT = 60
HOUR, DAY = 3600, 86_400
#: Different seconds that are gathered before they are written to the state, and rows that are returned together.
HELD, ROWS = 50_000, 10_000
COUNTS = "clave string, s bigint, n_1s bigint, n_10s bigint, n_60s bigint, n_3600s bigint, violacion string, exceso bigint, acumulado bigint, minutos_bloqueo int, hasta_s bigint"
PASSES = "clave string, s bigint, violacion string, acumulado bigint, minutos_bloqueo int, hasta_s bigint"
ENDS = "clave string, hasta_s bigint"


class Limits(StatefulProcessor):
    """``kind``: "counts" judges every request as it comes, "enforced" leaves out those of a blocked key, "ends" tells only when a key's blocks end."""

    def __init__(self, kind: str = "counts"):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day bigint, part bigint", "s array<bigint>, n array<bigint>")
        self.gate = handle.getValueState("gate", "s array<bigint>, n array<bigint>, total bigint, until bigint, burst bigint, minute bigint, hour bigint, timer bigint, parts bigint")

    def _state(self) -> tuple:
        return tuple(self.gate.get()) if self.gate.exists() else ([], [], 0, 0, None, None, None, 0, 0)

    def _hold(self, new: Counter, part: int) -> None:
        """Writes the seconds to the state, as a list for each day."""
        for day, seconds in groupby(sorted(new), key=lambda s: s // DAY):
            held = list(seconds)
            self.waiting.updateValue((day, part), (held, [new[s] for s in held]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, limits, first = Counter(), None, None
        past, counts, total, until, _, _, _, timer, parts = self._state()
        for pdf in rows:
            limits = tuple(None if pd.isna(pdf[c].iloc[0]) else int(pdf[c].iloc[0]) for c in ("burst", "minute", "hour"))
            new.update({int(s): int(n) for s, n in pdf.groupby("s")["n"].sum().items()})
            if len(new) >= HELD:
                first = min(new) if first is None else min(first, min(new))
                self._hold(new, parts)
                new, parts = Counter(), parts + 1
        if new:
            first = min(new) if first is None else min(first, min(new))
            self._hold(new, parts)
            parts += 1
        if first is not None:
            end = (first // SLOT + 1) * SLOT
            if not timer or end < timer:
                self.handle.registerTimer(end * 1000)
                timer = end
            self.gate.update((past, counts, total, until, *limits, timer, parts))
        yield pd.DataFrame()

    def _due(self, now: float) -> Iterator[tuple[int, int]]:
        """The waiting seconds whose slot has ended, in order, taken out of the state day by day; ``first`` is then the first that waits on."""
        self.first = None
        for day, keys in groupby(sorted(self.waiting.keys()), key=lambda k: k[0]):
            keys, held = list(keys), Counter()
            for at in keys:
                for s, n in zip(*self.waiting.getValue(at)):
                    held[s] += n
            due = sorted(s for s in held if (s // SLOT + 1) * SLOT <= now)
            yield from ((s, held[s]) for s in due)
            left = sorted(held.keys() - set(due))
            if due:
                for at in keys[1:] if left else keys:
                    self.waiting.removeKey(at)
                if left:
                    self.waiting.updateValue(keys[0], (left, [held[s] for s in left]))
            if left:
                self.first = left[0]
                return

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        past, counts, total, until, *limits, _, parts = self._state()
        gate = Gate(*limits, past=zip(past, counts), total=total, until=until)
        out, told = [], self.kind != "ends" or not until
        for s, n in self._due(now):
            if not told and gate.until <= s:
                out.append((key[0], gate.until))
                told = True
            found = gate.enforced(s, n) if self.kind == "enforced" else [gate.counted(s, n)]
            if self.kind != "ends":
                out += [(key[0], *r) for r in found]
            elif any(r[-1] is not None for r in found):
                told = False
            if len(out) >= ROWS:
                yield self._table(out)
                out = []
        if not told and gate.until <= now:
            out.append((key[0], gate.until))
            told = True
        gate.forget(int(now))
        kept = gate.kept()
        end = 0 if self.kind == "ends" and told else gate.until
        ahead = [(self.first // SLOT + 1) * SLOT] if self.first is not None else [end] if not told else [kept[-1][0] + HOUR] if kept else []
        if ahead:
            self.handle.registerTimer(ahead[0] * 1000)
        if ahead or gate.total:
            self.gate.update(([s for s, _ in kept], [n for _, n in kept], gate.total, end, *limits, ahead[0] if ahead else 0, parts))
        else:
            self.gate.clear()
        yield self._table(out) if out else pd.DataFrame()

    def _table(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self.columns()).astype(self.types())

    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.schema().split(", ")]

    def types(self) -> dict[str, str]:
        nullable = {"acumulado": "Int64", "minutos_bloqueo": "Int32", "hasta_s": "Int64"}
        return {c: t for c, t in nullable.items() if c in self.columns()}

    def schema(self) -> str:
        return {"counts": COUNTS, "enforced": PASSES, "ends": ENDS}[self.kind]

    def close(self) -> None:
        pass


def limit_stream(requests: DataFrame, key: str, ts: str, limits: DataFrame | None = None, kind: str = "counts", late: str = "10 minutes",
                 burst: int | None = BURST_LIMIT, minute: int = MINUTE_LIMIT, hour: int = HOUR_LIMIT) -> DataFrame:
    """The rows of ``sliding_rate`` with running violations and blocks (``counts``), of ``enforced``, or the ends of blocks (``ends``), as a stream.

    ``limits`` (clave, burst, minute, hour) names keys with limits of their own; a null burst knows none. It is joined
    to the stream as a static table.
    """
    rows = limited(requests.where(F.col(key).isNotNull()).withWatermark(ts, late), key, limits, burst, minute, hour)
    second = F.unix_seconds(F.date_trunc("second", ts))
    processor = Limits(kind)
    return rows.select("clave", ts, second.alias("s"), F.lit(1).cast("long").alias("n"), "burst", "minute", "hour").groupBy("clave").transformWithStateInPandas(
        processor, processor.schema(), "Append", "EventTime")


def run(stream: DataFrame, root: str) -> DataFrame:
    """``jobs.run_to_table`` with the state store that keyed state with several variables needs; the session's own setting is put back."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return jobs.run_to_table(stream, root)
    finally:
        conf.set(name, before)
