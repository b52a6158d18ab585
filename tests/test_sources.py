"""Files of odd shapes: no row may be lost."""

import json

from pyspark.sql import types as T

from callstrata.sources import calls as src

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("FECHA", "TELEFONO", "SENTIDO")])


def test_mixed_folder_loses_no_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text("FECHA;TELEFONO;SENTIDO\n1;x;in\nFECHA;TELEFONO;SENTIDO\n2;\"y;z\";out\n")
    (tmp_path / "b.csv").write_text("TELEFONO\np1\np2\n")
    (tmp_path / "c.csv").write_bytes("SENTIDO,otro,FECHA\nseñal,q,3\n".encode("latin-1"))
    got = sorted(tuple(str(x) for x in r) for r in src.read_mixed(spark, str(tmp_path), SCHEMA).collect())
    assert got == sorted([("1", "x", "in"), ("FECHA", "TELEFONO", "SENTIDO"), ("2", "y;z", "out"), ("None", "p1", "None"), ("None", "p2", "None"), ("3", "None", "señal")])
    assert {r["sep"] for r in src.sniff_sep(spark, str(tmp_path)).collect()} == {";", ","}


def test_json_of_any_layout(spark, tmp_path):
    rows, schema = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}], "a long, b string"
    for name, text in (("list", json.dumps(rows, indent=2)), ("lines", "\n".join(map(json.dumps, rows))), ("flat", json.dumps(rows)), ("nested", json.dumps({"registros": rows}, indent=1))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(text)
        stated = T._parse_datatype_string(schema) if name != "nested" else T._parse_datatype_string("registros array<struct<a:long,b:string>>")
        for s in (None, stated):
            got = src.read_json_records(spark, str(tmp_path / name), s).select("a", "b").collect()
            assert sorted(map(tuple, got)) == [(1, "x"), (2, "y")], (name, s)


def test_latest_result_reads_one_result(spark, tmp_path):
    for name, v in (("resultado_in_20240101", 1), ("resultado_in_20240301", 2), ("resultado_out_20240401", 3), ("x_in_y/resultado_out_20240501", 4)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.json").write_text(json.dumps({"predicciones": [{"ds": "2024-01-01", "yhat": v}]}))
    (tmp_path / "resultado_out_20240601").mkdir()
    (tmp_path / "resultado_out_20240601" / "part-0.json").write_text(json.dumps({"predicciones": [{"ds": "2024-01-01", "yhat": 5}]}))
    assert [r["yhat"] for r in src.latest_result(spark, str(tmp_path), "out").collect()] == [5]
    (tmp_path / "x_in_y" / "resultado_out_20240501.json").unlink()
    assert [r["yhat"] for r in src.latest_result(spark, str(tmp_path), "in").collect()] == [2]
