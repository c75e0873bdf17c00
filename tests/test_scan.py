"""Snapshots chosen by directory names, and delimited text whose bad lines are kept apart."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierline.sources import scan, sink

DAYS = [dt.date(2001, 4, 30), dt.date(2001, 5, 31), dt.date(2001, 7, 31)]


@pytest.fixture(scope="module")
def dated(spark):
    """A table of three days and a null day; only the file of 31 May can be read."""
    path = sink.fresh_path(spark, "by-day")
    rows = [(i, DAYS[i % 3]) for i in range(30)] + [(99, None)]
    sink.write_partitions(spark.createDataFrame(rows, "i int, d date"), path, ["d"])
    for file in Path(path).glob("d=*/*.parquet"):
        if "2001-05-31" not in file.parent.name:
            file.write_bytes(b"not parquet")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    return path


@pytest.mark.parametrize("wanted", [dt.date(2001, 5, 31), dt.date(2001, 6, 30), "2001-05-31", "2001-07"])
def test_other_snapshots_are_not_opened(spark, dated, wanted):
    out = scan.scan_snapshot_or_latest(spark, dated, "d", wanted)
    assert sorted(r["i"] for r in out.collect()) == list(range(1, 30, 3))
    assert out.columns == ["i", "d"]


def test_newest_snapshot_if_all_are_later(spark):
    path = sink.fresh_path(spark, "by-number")
    rows = spark.range(40).select("id", (F.col("id") % 4 + 8).cast("int").alias("m"))
    sink.write_partitions(rows, path, ["m"])
    pick = lambda wanted: {r["m"] for r in scan.scan_snapshot_or_latest(spark, path, "m", wanted).collect()}
    assert pick(7) == {11}
    assert pick(9) == {9}
    assert pick(10) == {10}  # as numbers, not as text
    assert pick(200) == {11}


def test_names_with_signs(spark):
    path = sink.fresh_path(spark, "by-name")
    sink.write_partitions(spark.createDataFrame([(1, "a:1/x"), (2, "b 2%")], "i int, s string"), path, ["s"])
    assert [tuple(r) for r in scan.scan_snapshot_or_latest(spark, path, "s", "a~").collect()] == [(1, "a:1/x")]
    assert [tuple(r) for r in scan.scan_snapshot_or_latest(spark, path, "s", "c").collect()] == [(2, "b 2%")]


def test_a_table_without_snapshots(spark):
    path = sink.fresh_path(spark, "none")
    spark.range(3).write.parquet(path)
    with pytest.raises(FileNotFoundError):
        scan.scan_snapshot_or_latest(spark, path, "d", 1)


SCHEMA = T.StructType().add("id", "long").add("day", "date").add("amount", "double").add("name", "string")


def test_bad_lines_are_kept_apart(spark, tmp_path):
    good = ["1,2001-01-31,2.5,a", "2,,,", '3,2001-02-28,1e3,"x, y"']
    bad = ["x,2001-01-31,2.5,a", "4,2001-01-31,much,a", "5,31/01/2001,1.0,a", "6,2001-01-31", "7,2001-01-31,1.0,a,b"]
    (tmp_path / "a.csv").write_text("\n".join(["id,day,amount,name", *good, *bad[:2]]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join(["id,day,amount,name", *bad[2:]]) + "\n")
    (tmp_path / "c.csv").write_text("id,day,amount,name\n")
    rows, lines = scan.scan_csv_checked(spark, str(tmp_path), SCHEMA)
    assert sorted(map(tuple, rows.collect())) == [
        (1, dt.date(2001, 1, 31), 2.5, "a"), (2, None, None, None), (3, dt.date(2001, 2, 28), 1000.0, "x, y"),
    ]
    assert rows.columns == SCHEMA.names
    assert sorted(r["line"] for r in lines.collect()) == sorted(bad)
    assert {r["line"]: Path(r["file"]).name for r in lines.collect()}[bad[3]] == "b.csv"
    assert lines.count() == len(bad) and rows.count() == len(good)
