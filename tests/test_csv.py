import math

import pytest

from flowbench.operators.split import check_weekdays
from flowbench.sources import csv

HEADER = "Flow ID, Fwd Header Length, Fwd Header Length,Flow Bytes/s, Label\n"


def write(folder, name, text, encoding="utf-8"):
    (folder / name).write_bytes(text.encode(encoding))


@pytest.fixture()
def folder(tmp_path):
    where = tmp_path / "raw [1] a+b"
    where.mkdir()
    write(where, "Monday-A.csv", "﻿" + HEADER
          + "1,2,3,Infinity,BENIGN\n2,3,4,NaN,BENIGN\n3,4,5,inf,BENIGN\n4,5,6,,BENIGN\n"
          + "5,6,7,-Infinity,NA\n6,7,8,NA,\"a \"\"q\"\", b\"\n7,8\n")
    write(where, "tuesday-B.csv", HEADER + "8,2,3,1e3,Web \x96 XSS\n", "latin1")
    write(where, "WEDNESDAY-C.csv",
          "Flow ID,Extra 1,Flow Bytes/s, Label,Flag\n9,1d,2.5,BENIGN,True\n10,2,2.5,Größe,false\n")
    write(where, "Thursday-D 1.csv", "\n" + HEADER + "11,1,1, 7 ,BENIGN\n")
    write(where, "Friday-E.csv", HEADER + "12,1,1,8,Bot\n")
    write(where, "notes.csv", HEADER)
    write(where, "readme.txt", "not,a,flow\n")
    (where / "nested").mkdir()
    write(where / "nested", "Friday.csv", HEADER + "99,1,1,1,BENIGN\n")
    return where


def test_inventory(spark, folder):
    files = {r.source_file: r for r in csv.csv_inventory(spark, str(folder)).collect()}
    assert sorted(files) == ["Friday-E.csv", "Monday-A.csv", "Thursday-D 1.csv", "WEDNESDAY-C.csv",
                             "notes.csv", "tuesday-B.csv"]
    assert [n for n, f in files.items() if not f.is_utf8] == ["tuesday-B.csv"]
    assert files["Thursday-D 1.csv"].header + "\n" == HEADER


def test_inventory_needs_no_sort_of_the_text(spark, folder):
    plan = csv.csv_inventory(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "Sort" not in plan


def test_load_raw_data(spark, folder):
    df = csv.load_raw_data(spark, str(folder))
    assert dict(df.dtypes) == {
        "flow_id": "bigint", "fwd_header_length": "bigint", "fwd_header_length_1": "bigint",
        "flow_bytes_s": "double", "label": "string", "source_file": "string",
        "extra_1": "string", "flag": "boolean",
    }
    rows = {r.flow_id: r for r in df.collect()}
    assert sorted(rows) == list(range(1, 13))
    assert [rows[i].flow_bytes_s for i in range(1, 8)] == [
        math.inf, None, math.inf, None, -math.inf, None, None,
    ]
    assert rows[5].label is None and rows[6].label == 'a "q", b' and rows[7].label is None
    assert rows[8].label == "Web \x96 XSS" and rows[8].source_file == "tuesday-B.csv"
    assert rows[9].extra_1 == "1d" and rows[9].flag is True and rows[9].fwd_header_length is None
    assert rows[10].label == "Größe" and rows[10].flag is False and rows[11].flow_bytes_s == 7.0
    check_weekdays(df)


def test_known_types_save_the_inference(spark, folder):
    types = csv.infer_types(csv.load_text(spark, str(folder)))
    again = csv.load_raw_data(spark, str(folder), types)
    assert again.dtypes == csv.load_raw_data(spark, str(folder)).dtypes


@pytest.mark.parametrize(
    "cells, wanted",
    [
        (["1", " 2", "+3", ""], "bigint"), (["1", "2.5"], "double"), (["1", "INF"], "double"),
        (["True", "false", "NA"], "boolean"), (["True", "1"], "string"), (["", "NaN"], "double"),
        (["1d"], "string"), (["0x1p3"], "string"), (["99999999999999999999"], "double"),
        (["1e400", ".5", "5."], "double"), ([" "], "string"), ([" NA"], "string"),
        (["1_000"], "string"), (["-"], "string"),
    ],
)
def test_types_of_cells(spark, cells, wanted):
    df = spark.createDataFrame([(c,) for c in cells], "x string")
    types = csv.infer_types(df)
    assert types == {"x": wanted}
    assert csv.apply_types(df, types).dtypes == [("x", wanted)]
    csv.apply_types(df, types).collect()


def test_header_names():
    assert csv.header_names("x,x,x,,\"a,b\"") == ["x", "x.1", "x.2", "Unnamed: 3", "a,b"]
    assert csv.header_names("x,x.1,x") == ["x", "x.1", "x.2"]


def test_errors(spark, folder, tmp_path):
    for empty in (tmp_path / "none", tmp_path):
        with pytest.raises(FileNotFoundError, match="holds no CSV files"):
            csv.load_raw_data(spark, str(empty))
    write(folder, "Friday-F.csv", "a,b\n1,2,3\n")
    with pytest.raises(ValueError, match="Friday-F.csv: a line has more cells"):
        csv.load_raw_data(spark, str(folder))
    write(folder, "Friday-F.csv", "A b,a-B\n1,2\n")
    with pytest.raises(ValueError, match="a_b"):
        csv.load_raw_data(spark, str(folder))


def test_line_breaks_inside_quotes(spark, tmp_path):
    """Files that need it are read across lines by default; the others stay splittable."""
    write(tmp_path, "a.csv", 'id,text\n1,"two\nlines"\n2,one\n')
    write(tmp_path, "b.csv", 'id,text\n3,"a ""q"""\n')
    write(tmp_path, "c.csv", 'id,text\n4,"\xe9\n"\n', "latin1")
    rows = csv.load_raw_data(spark, str(tmp_path)).orderBy("id").collect()
    assert [r.text for r in rows] == ["two\nlines", "one", 'a "q"', "\xe9\n"]
    broken = {r.source_file: r.broken for r in csv.csv_inventory(spark, str(tmp_path)).collect()}
    assert broken == {"a.csv": True, "b.csv": False, "c.csv": True}


def test_surplus_cells_raise_with_known_types_too(spark, tmp_path):
    write(tmp_path, "Monday.csv", "id, Label\n1,BENIGN\n2,BENIGN,EXTRA\n")
    df = csv.load_raw_data(spark, str(tmp_path), types={"id": "bigint", "label": "string"})
    with pytest.raises(Exception, match="Monday.csv: a line has more cells"):
        df.collect()


def test_one_file(spark, folder):
    df = csv.load_csv_file(spark, f"{folder}/tuesday-B.csv")
    row = df.first()
    assert df.count() == 1 and row.label == "Web \x96 XSS" and row.flow_bytes_s == 1000.0
