"""The commit log: only whole runs are seen."""

import os

import pytest
from callstrata.sources import runs

SHAPE = "k long, v string"


def table(spark, n, mark):
    return spark.createDataFrame([(i, f"{mark}{i}" if i % 3 else None) for i in range(n)], SHAPE).repartition(3)


def rows(df):
    return sorted((r["k"], r["v"]) for r in df.collect())


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_a_killed_write_leaves_the_former_run_readable(spark, tmp_path, fmt, monkeypatch):
    root = str(tmp_path)
    first = table(spark, 20, "a")
    log = runs.write_run(spark, root, "1", {"t": first, "u": table(spark, 5, "u"), "none": first.where("k < 0")}, fmt)
    assert {r["tabla"]: r["filas"] for r in runs.inventory(spark, root).collect()} == {"t": 20, "u": 5, "none": 0}
    assert runs.read_run(spark, root, "none", SHAPE).count() == 0
    assert log.count() >= 2 and runs.damaged(spark, root, "1").count() == 0

    def killed(*_):
        raise KeyboardInterrupt

    whole = runs._written
    monkeypatch.setattr(runs, "_written", lambda *a: whole(*a) if a[4] == "t" else killed())
    with pytest.raises(KeyboardInterrupt):
        runs.write_run(spark, root, "2", {"t": table(spark, 7, "b"), "u": first}, fmt)
    assert os.path.isdir(f"{root}/data/2")
    assert rows(runs.read_run(spark, root, "t", SHAPE)) == rows(first)
    assert [r["corrida"] for r in runs.inventory(spark, root).select("corrida").distinct().collect()] == ["1"]
    monkeypatch.undo()
    runs.write_run(spark, root, "2", {"t": table(spark, 7, "b")}, fmt)
    assert runs.read_run(spark, root, "t", SHAPE).count() == 7 and runs.read_run(spark, root, "t", SHAPE, "1").count() == 20


def test_a_repeated_run_replaces_itself_and_damage_shows(spark, tmp_path):
    root = str(tmp_path)
    runs.write_run(spark, root, "x", {"t": table(spark, 9, "old")})
    runs.write_run(spark, root, "x", {"t": table(spark, 4, "new")})
    assert runs.read_run(spark, root, "t", SHAPE).count() == 4 and runs.inventory(spark, root).first()["filas"] == 4
    name = runs.committed(spark, root, "x").where("filas > 0").first()["archivo"].removeprefix("file:")
    os.unlink(name)
    assert runs.damaged(spark, root, "x").count() == 1
    with pytest.raises(FileNotFoundError):
        runs.read_run(spark, root, "none", SHAPE)
