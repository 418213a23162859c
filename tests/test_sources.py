"""Outcome of file conversion and conflicts of period keys on planted cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from termlens.operators import quality as QL
from termlens.sources import files as FS


def test_every_file_gets_its_outcome(spark, tmp_path):
    root = tmp_path / "in"
    for name, raw in {"a/good.csv": "id,name\n1,x\n2,y\n".encode(), "a/empty.csv": b"", "a/header.csv": b"id,name\n", "a/bad.csv": b"id,name\n1,x\n2,y,z,w\n",
                      "a/gbk.csv": "id,name\n1,学生\n2,成绩\n3,x\n".encode("gbk"), "b/other.csv": b"k\n7\n", "c/none.csv": b""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)
    got = {(r["dataset"], r["file"]): (r["ok"], r["rows"], r["encoding"], r["message"]) for r in FS.convert_files(spark, str(root), str(tmp_path / "out")).collect()}
    assert got["a", "good.csv"] == (True, 2, "UTF-8", "converted") and got["a", "gbk.csv"] == (True, 3, "GBK", "converted")
    assert got["a", "empty.csv"] == (False, 0, None, "empty file") == got["c", "none.csv"]
    assert got["a", "header.csv"] == (False, 0, None, "no rows") and got["b", "other.csv"] == (True, 1, "UTF-8", "converted")
    ok, _, _, message = got["a", "bad.csv"]
    assert not ok and message == "malformed lines: 1" and len(got) == 7
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["name"] for r in back.where("file = 'gbk.csv'").collect()) == ["x", "学生", "成绩"]
    assert {r["file"] for r in back.select("file").distinct().collect()} == {"good.csv", "gbk.csv", "other.csv"}


def test_planted_key_conflicts(spark):
    rows = [("s", 1, "e1", "2020-2021-1"), ("s", 1, "e1", "2020-2021-2"), ("s", 1, "e2", "2020-2021-1"), ("s", 1, "e2", "2020-2021-1"), ("s", 2, "e1", None),
            ("s", 2, "e1", "2020"), ("t", 1, "e1", None)]
    k = spark.createDataFrame(rows, "source string, entity int, event string, pk string")
    got = {r["source"]: r for r in QL.period_key_quality(k).collect()}
    assert (got["s"]["n_events"], got["s"]["conflicting_events"]) == (3, 1) and (got["t"]["n_events"], got["t"]["conflicting_events"]) == (1, 0)
    assert got["s"]["meets_target"] and not got["t"]["meets_target"] and abs(got["s"]["format_ok_rate"] - 4 / 6) < 1e-12
    assert QL.key_conflicts(k.where(F.lit(False)), ["source"], "entity", "event", "pk").count() == 0
