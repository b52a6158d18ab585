"""Hot keys: a third or more of the rows in one group, against brute force in plain Python."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from callstrata.functions import numbering
from callstrata.functions.joins import salted_left_join
from callstrata.operators import governance, roles


@pytest.fixture(scope="module")
def requests():
    rnd = random.Random(7)
    start = dt.datetime(2024, 1, 1, 23, 0)
    rows = []
    for i in range(6000):
        key = "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(20)}"
        burst = rnd.random() < 0.3
        sec = rnd.choice([3599, 3600, 7199, 7205, 100]) + rnd.randrange(8) if burst else rnd.randrange(4 * 3600)
        rows.append((i, key, start + dt.timedelta(seconds=sec, microseconds=rnd.randrange(1_000_000))))
    return rows


def test_sliding_rate_equals_brute_force(spark, requests):
    df = spark.createDataFrame(requests, "id int, k string, ts timestamp_ntz")
    got = {(r["clave"], r["s"]): (r["n_1s"], r["n_10s"], r["n_60s"], r["n_3600s"], r["violacion"])
           for r in governance.sliding_rate(df, "k", "ts").collect()}
    per = defaultdict(Counter)
    for _, k, t in requests:
        per[k][int((t.replace(microsecond=0) - dt.datetime(1970, 1, 1)).total_seconds())] += 1
    want = {}
    for k, c in per.items():
        for s, n in c.items():
            w = [sum(c[x] for x in c if s - d < x <= s) for d in (10, 60, 3600)]
            broken = "rafaga" if w[0] > 10 else "minuto" if w[1] > 60 else "hora" if w[2] > 300 else None
            want[(k, s)] = (n, *w, broken)
    assert got == want
    assert any(v[4] for v in want.values())


def _one_by_one(requests, burst=10, minute=60, hour=300, blocking=False):
    """Every request in order: (key, second) -> [violations, total after the second, kind, block of the last burst]."""
    seen, total, until, out = defaultdict(list), Counter(), Counter(), {}
    for k, s in sorted((k, int((t.replace(microsecond=0) - dt.datetime(1970, 1, 1)).total_seconds())) for _, k, t in requests):
        if blocking and s < until[k]:
            continue
        seen[k].append(s)
        n = [sum(s - w < x for x in seen[k]) for w in (10, 60, 3600)]
        kind = "rafaga" if n[0] > burst else "minuto" if n[1] > minute else "hora" if n[2] > hour else None
        if kind:
            total[k] += 1
            stop = 15 * 2 ** min(total[k], 5) if kind == "rafaga" and total[k] >= 3 else None
            if stop:
                until[k] = s + 60 * stop
            out.setdefault((k, s), []).append((kind, total[k], stop))
    return out


def test_blocks_count_single_requests(spark, requests):
    df = spark.createDataFrame(requests, "id int, k string, ts timestamp_ntz")
    got = {(r["clave"], r["s"]): (r["exceso"], r["acumulado"], r["violacion"] == "rafaga", r["minutos_bloqueo"])
           for r in governance.escalating_block(governance.sliding_rate(df, "k", "ts")).collect()}
    want = {}
    for key, rows in _one_by_one(requests).items():
        burst = any(kind == "rafaga" for kind, _, _ in rows)
        n = rows[-1][1]
        want[key] = (len(rows), n, burst, 15 * 2 ** min(n, 5) if burst and n >= 3 else None)
    assert got == want and len(want) > 3 and any(v[3] for v in want.values())


def test_twelve_requests_in_a_second_are_two_violations(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, "k", at) for i in range(12)], "id int, k string, ts timestamp_ntz")
    r = governance.escalating_block(governance.sliding_rate(df, "k", "ts")).first()
    assert (r["exceso"], r["acumulado"], r["minutos_bloqueo"]) == (2, 2, None)
    assert governance.enforced(df, "k", "ts").count() == 2


@pytest.mark.parametrize("limits", [(10, 60, 300), (2, 5, 9)])
def test_blocked_requests_count_no_more(spark, requests, limits):
    df = spark.createDataFrame(requests, "id int, k string, ts timestamp_ntz")
    got = sorted((r["clave"], r["s"], r["violacion"], r["acumulado"], r["minutos_bloqueo"]) for r in governance.enforced(df, "k", "ts", *limits).collect())
    want = sorted((*key, *row) for key, rows in _one_by_one(requests, *limits, blocking=True).items() for row in rows)
    assert [tuple(None if x != x else x for x in r) for r in got] == want and want


def test_limits_of_users_and_of_all(spark, requests):
    df = spark.createDataFrame(requests, "id int, k string, ts timestamp_ntz")
    per_user = governance.user_rate(df, "k", "ts")
    assert {r["violacion"] for r in per_user.collect()} <= {None, "minuto", "hora"} and per_user.where("violacion = 'hora'").count() > 0
    whole = governance.global_rate(df, "ts")
    assert whole.agg({"n_1s": "sum"}).first()[0] == len(requests) and {r["clave"] for r in whole.collect()} == {"global"}


def test_activity_sessions_equal_brute_force(spark):
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(9)}",
             start + dt.timedelta(seconds=rnd.randrange(86400 * 2), microseconds=rnd.randrange(1_000_000))) for _ in range(900)]
    rows += [("edge", start), ("edge", start + dt.timedelta(minutes=30)), ("edge", start + dt.timedelta(minutes=60, microseconds=1))]
    got = sorted((r["clave"], r["inicio"], r["fin"], r["eventos"]) for r in governance.activity_sessions(
        spark.createDataFrame(rows, "k string, ts timestamp_ntz"), "k", "ts").collect())
    want, by = [], defaultdict(list)
    for k, t in rows:
        by[k].append(t)
    for k, ts in by.items():
        ts.sort()
        cur = [ts[0]]
        for t in ts[1:]:
            if t - cur[-1] > dt.timedelta(minutes=30):
                want.append((k, cur[0], cur[-1], len(cur)))
                cur = []
            cur.append(t)
        want.append((k, cur[0], cur[-1], len(cur)))
    assert got == sorted(want)


def test_salted_join_keeps_every_row_once(spark):
    rows = [(i, None if i % 3 == 0 else "hot" if i % 3 == 1 else f"p{i}") for i in range(3000)]
    dim = [("hot", "A")] + [(f"p{i}", "B") for i in range(0, 3000, 2)]
    out = salted_left_join(spark.createDataFrame(rows, "call_id int, TELEFONO string"), spark.createDataFrame(dim, "TELEFONO string, c string"),
                           "TELEFONO", "call_id")
    known = dict(dim)
    assert {r["call_id"]: r["c"] for r in out.collect()} == {i: known.get(p) for i, p in rows}
    assert out.count() == 3000


def test_calls_by_user_with_one_busy_phone(spark):
    start = dt.datetime(2024, 1, 1)
    calls = [("hot", start + dt.timedelta(hours=i), "Si" if i % 2 else "No", 10) for i in range(240)] + [("p", start, "Si", None), (None, start, "Si", 1)]
    df = spark.createDataFrame(calls, "TELEFONO string, FECHA timestamp_ntz, ATENDIDA string, DURACION int")
    users = spark.createDataFrame([("hot", "u1", "A"), ("p", "u2", "A"), ("none", "u3", "B"), ("p", "u4", "B"), (None, "u5", "B")],
                                  "TELEFONO string, USUARIO string, CARGO string")
    got = {r["USUARIO"]: r for r in roles.calls_by_user(df, users).collect()}
    assert set(got) == {"u1", "u2", "u3", "u4", "u5", None}
    assert got[None]["llamadas"] == 1 and sum(r["llamadas"] for r in got.values()) == len(calls)
    assert all((got[u]["llamadas"], got[u]["dias"], got[u]["tasa_atencion"]) == (0, 0, None) for u in ("u3", "u4", "u5"))
    assert (got["u1"]["llamadas"], got["u1"]["dias"], got["u1"]["llamadas_por_dia"], got["u1"]["tasa_atencion"]) == (240, 10, 24.0, 50.0)
    assert got["u2"]["duracion_media"] is None


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_numbers_are_consecutive(spark, width):
    ids = [5, 17, 18, 19, 40, 999, 1000, 2000]
    out = numbering.number_rows(spark.createDataFrame([(i,) for i in ids], "id bigint"), "id", "n", width)
    assert {r["id"]: r["n"] for r in out.collect()} == {i: k + 1 for k, i in enumerate(ids)}


def test_scan_reads_whole_texts(spark):
    long = "x" * 200_000 + "<SCRIPT" + "y" * 10
    df = spark.createDataFrame([(1, long), (2, "nothing"), (3, "Drop Table t; eval(1)")], "id int, t string")
    got = sorted((r["id"], r["patron"]) for r in governance.scan_text(df, "id", "t").collect())
    assert got == [(1, "<script"), (3, "drop table"), (3, "eval(")]
