"""Files of mixed headers, broken ones set aside."""

from tierflow.schemas import LOG_COLUMNS
from tierflow.sources import logs
from tierflow.sources.mixed import read_mixed

WANTED = ["LineId", "Level", "Content"]


def test_layouts_broken_files_and_broken_lines(spark, tmp_path):
    texts = {
        "a.csv": 'LineId,Level,Content\n1,INFO,"say ""hi"", äß"\n2,,""\n\n3,WARN\n4,a,b,c\n',
        "b.csv": '﻿"Content",Odd `x`, LineId\r\nx,9,5\r\n"y,z",9,6\r\n',
        "c.csv": "LineId,Level,Content\n7,INFO,c\nLineId,Level,Content\n8,INFO,d\n",
        "empty.csv": "",
        "blank.csv": "\n\n",
        "twice.csv": "LineId,Level,Level\n9,a,b\n",
        "other.csv": "Level,Content\nINFO,x\n",
        "only.csv": "LineId\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    scan = read_mixed(spark, f"{tmp_path}/*.csv", WANTED, needed=["LineId"])
    rows = {r.LineId: (r.path.rsplit("/", 1)[1], r.Level, r.Content) for r in scan.rows.collect()}
    assert rows.keys() == {"1", "2", "5", "6", "7", "8"} and scan.rows.count() == 6
    assert rows["1"] == ("a.csv", "INFO", 'say "hi", äß')
    assert rows["5"] == ("b.csv", None, "x") and rows["6"] == ("b.csv", None, "y,z")
    assert rows["8"] == ("c.csv", "INFO", "d")
    # A file of no bytes is not in Spark's listing.
    aside = {r.path.rsplit("/", 1)[1]: r.reason for r in scan.files_aside.collect()}
    assert aside == {
        "blank.csv": "empty",
        "twice.csv": "column named twice",
        "other.csv": "lacks LineId",
    }
    assert sorted(r.line for r in scan.rows_aside.collect()) == ["3,WARN", "4,a,b,c"]


def test_folder_without_usable_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    scan = read_mixed(spark, f"{tmp_path}/*.csv", WANTED, needed=["LineId"])
    assert scan.rows.collect() == [] and scan.rows_aside.collect() == []
    assert scan.files_aside.count() == 1


def test_same_rows_as_the_strict_scan(spark, tmp_path):
    lines = [",".join(LOG_COLUMNS)] + [",".join(f"{i}" for _ in LOG_COLUMNS) for i in range(50)]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    strict = logs.read_logs(spark, f"{tmp_path}/*.csv").select(*LOG_COLUMNS)
    mixed = read_mixed(spark, f"{tmp_path}/*.csv", LOG_COLUMNS).rows.select(*LOG_COLUMNS)
    assert sorted(map(tuple, strict.collect())) == sorted(map(tuple, mixed.collect()))
