"""Limits as a stream: trailing counts, violations, blocks and their ends equal the batch tables, however the rows arrive."""

import datetime as dt
import random
from collections import Counter
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from callstrata.operators import governance
from callstrata.streaming import jobs, limits

DAY = dt.datetime(2024, 3, 1, 12)
SHAPE = "k string, ts timestamp_ntz"


def traffic(seed=1):
    rng = random.Random(seed)
    rows = [("hot", DAY + dt.timedelta(seconds=rng.randrange(0, 900) if rng.random() < 0.5 else rng.randrange(0, 12) + 300)) for _ in range(300)]
    rows += [("calm", DAY + dt.timedelta(seconds=rng.randrange(0, 7200))) for _ in range(40)]
    rows += [("own", DAY + dt.timedelta(seconds=rng.randrange(0, 3600))) for _ in range(40)]
    return sorted(rows, key=lambda r: r[1])


def brute(rows, burst, minute, hour):
    """One request after the other, each against everything before it."""
    out, seen, total, until = [], [], 0, DAY - dt.timedelta(days=1)
    for t in rows:
        if t < until:
            continue
        n = [sum(t - dt.timedelta(seconds=w) < x for x in seen) + 1 for w in (10, 60, 3600)]
        seen.append(t)
        kind = next((name for name, c, limit in zip(("rafaga", "minuto", "hora"), n, (burst, minute, hour)) if limit is not None and c > limit), None)
        if kind:
            total += 1
            stop = 15 * 2 ** min(total, 5) if kind == "rafaga" and total >= 3 else None
            until = t + dt.timedelta(minutes=stop) if stop else until
            out.append((int(t.replace(tzinfo=dt.timezone.utc).timestamp()), kind, total, stop))
    return out


def land(spark, tmp_path, rows, files):
    src = str(tmp_path / "in")
    for part in files(rows):
        df = spark.createDataFrame(part, SHAPE).coalesce(1)
        jobs.land(df, src)
    return jobs.landed(spark, src, df.schema, "ts", files_per_batch=1)


def close(rows, hours=30):
    """A row far behind the rest moves the watermark past them."""
    return [*rows, ("end", DAY + dt.timedelta(hours=hours))]


def halves(rows):
    """Two files whose rows overlap in time by less than the watermark's delay."""
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    early = [r for r in shuffled if r[1] < DAY + dt.timedelta(minutes=8)]
    late = [r for r in shuffled if r[1] >= DAY + dt.timedelta(minutes=8)]
    moved = [k for k, r in enumerate(early) if r[1] >= DAY + dt.timedelta(minutes=4)][:20]
    return [[r for k, r in enumerate(early) if k not in moved], [*(early[k] for k in moved), *late], close([])]


def test_counts_equal_the_batch(spark, tmp_path):
    rows = traffic()
    stream = limits.limit_stream(land(spark, tmp_path, rows, halves), "k", "ts", burst=3, minute=6, hour=30)
    got = limits.run(stream, str(tmp_path / "job"))
    batch = spark.createDataFrame(rows, SHAPE)
    rates = governance.sliding_rate(batch, "k", "ts", 3, 6, 30)
    want = rates.join(governance.escalating_block(rates).select("clave", "s", "acumulado", "minutos_bloqueo", "hasta_s"), ["clave", "s"], "left")
    cols = [c.split()[0] for c in limits.COUNTS.split(", ")]
    mine, theirs = ({str(r) for r in t.select(cols).collect()} for t in (got, want))
    assert mine == theirs, (sorted(mine - theirs)[:3], sorted(theirs - mine)[:3])
    assert got.where("minutos_bloqueo IS NOT NULL").count() > 0


def test_enforced_equals_one_request_after_the_other(spark, tmp_path):
    rows = traffic(3)
    own = spark.createDataFrame([("own", None, 2, 20)], "clave string, burst long, minute long, hour long")
    stream = limits.limit_stream(land(spark, tmp_path, rows, halves), "k", "ts", own, "enforced", burst=3, minute=6, hour=30)
    got = limits.run(stream, str(tmp_path / "job")).collect()
    batch = governance.enforced(spark.createDataFrame(rows, SHAPE), "k", "ts", 3, 6, 30, own).collect()
    for found in (got, batch):
        for key, limit in (("hot", (3, 6, 30)), ("calm", (3, 6, 30)), ("own", (None, 2, 20))):
            mine = sorted((r["s"], r["violacion"], r["acumulado"], r["minutos_bloqueo"]) for r in found if r["clave"] == key)
            assert mine == sorted(brute([t for k, t in rows if k == key], *limit), key=lambda r: r[2]), key
    assert any(r["minutos_bloqueo"] for r in got)


def test_a_timer_ends_the_block(spark, tmp_path):
    rows = traffic(4)
    kinds = {kind: limits.run(limits.limit_stream(land(spark, tmp_path / kind, rows, halves), "k", "ts", None, kind, burst=3, minute=60, hour=900), str(tmp_path / f"job-{kind}")).collect()
             for kind in ("counts", "ends")}
    last = {}
    for r in kinds["counts"]:
        if r["hasta_s"]:
            last[r["clave"]] = max(last.get(r["clave"], 0), r["hasta_s"])
    ends = {}
    for r in kinds["ends"]:
        ends.setdefault(r["clave"], []).append(r["hasta_s"])
    assert last and {k: max(v) for k, v in ends.items()} == last


def test_running_sums_equal_plain_sums():
    rng = random.Random(5)
    gate, past, s = governance.Gate(5, 20, 100), [], 1000
    for _ in range(400):
        s, n = s + rng.choice((1, 1, 2, 9, 70, 4000)), rng.randrange(1, 9)
        past.append((s, n))
        row = gate.counted(s, n)
        assert list(row[2:5]) == [sum(c for t, c in past if t > s - w) for w in (10, 60, 3600)]
        again = governance.Gate(5, 20, 100, gate.kept(), gate.total, gate.until)
        again.forget(s)
        assert again.sums == gate.sums
    gate.forget(s + 3600)
    assert gate.kept() == [] and gate.sums == [0, 0, 0]


class Held:
    """State in memory: a map or a single value."""

    def __init__(self):
        self.rows, self.largest = {}, 0

    def updateValue(self, at, row):
        self.rows[at], self.largest = row, max(self.largest, len(row[0]))

    def update(self, row):
        self.rows[None] = row

    def getValue(self, at):
        return self.rows[at]

    def get(self):
        return self.rows[None]

    def exists(self):
        return None in self.rows

    def containsKey(self, at):
        return at in self.rows

    def removeKey(self, at):
        del self.rows[at]

    def keys(self):
        return iter(list(self.rows))

    def iterator(self):
        return iter(list(self.rows.items()))

    def clear(self):
        self.rows.clear()


def test_a_long_wait_is_read_and_returned_in_parts():
    rng, kept, timers = random.Random(6), Held(), []
    one = limits.Limits()
    state = {"waiting": kept, "gate": Held()}
    one.init(SimpleNamespace(getMapState=lambda name, *_: state[name], getValueState=lambda name, _: state[name], registerTimer=timers.append))
    seconds = [rng.randrange(0, 4 * 86_400) for _ in range(300_000)]
    frames = (pd.DataFrame({"s": seconds[k:k + 10_000], "n": 1, "burst": 3, "minute": 9, "hour": 300}) for k in range(0, len(seconds), 10_000))
    list(one.handleInputRows(("k",), frames, None))
    parts = [t for now in (199_980, 500_040) for t in one.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now * 1000), None)]
    assert max(len(t) for t in parts) <= 20_000 and kept.largest <= 90_000 and not kept.rows
    gate = governance.Gate(3, 9, 300)
    want = [gate.counted(s, n) for s, n in sorted(Counter(seconds).items())]
    got = [tuple(None if pd.isna(x) else x for x in r[1:]) for t in parts for r in t.itertuples(index=False)]
    assert got == want and any(r[8] for r in want)
    assert timers[0] == (min(seconds) // 60 + 1) * 60_000
