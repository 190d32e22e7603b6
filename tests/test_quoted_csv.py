"""Quoted line breaks across byte ranges, against Python's csv module and Spark's reader of whole files."""

import csv
import random

import pytest

from flowbench.sources import csv as flow_csv


def files(folder, line_end, encoding):
    rng = random.Random(6)
    cells = ["1", "", " x ", "a,b", 'say ""hi""'.replace('""', '"'), "two\nlines", "\n", "four\n\n\nlines, with \"quotes\"\n", "é", "z" * 40]
    for k in range(3):
        with open(f"{folder}/f{k}.csv", "w", newline="", encoding=encoding) as out:
            out.write(line_end if k == 1 else "")
            writer = csv.writer(out, lineterminator=line_end)
            writer.writerow(["first", "quoted\nname" if k == 2 else "second", "third"])
            for i in range(400):
                writer.writerow([f"{k}-{i}", *rng.choices(cells, k=2)])
                if i % 50 == 7:
                    out.write(line_end)


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    yield lambda size: [spark.conf.set(n, v) for n, v in zip(names, (size, "16"))]
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.mark.parametrize("line_end, encoding, size", [("\n", "UTF-8", "150"), ("\n", "ISO-8859-1", "701"), ("\r\n", "UTF-8", "333"), ("\n", "UTF-8", "64m")])
def test_ranges_equal_the_reader_of_whole_files(spark, tmp_path, small_ranges, line_end, encoding, size):
    files(tmp_path, line_end, encoding)
    wanted = []
    for path in sorted(tmp_path.iterdir()):
        with open(path, newline="", encoding=encoding) as source:
            wanted += [(*(cell or None for cell in row), None) for row in [r for r in csv.reader(source) if r][1:]]
    if line_end == "\n":  # with others, Spark's reader of whole files takes the first line break it meets for theirs
        reader = spark.read.schema("a string, b string, c string, d string").option("header", True).option("encoding", encoding)
        whole = reader.option("escape", '"').option("multiLine", True).csv(f"{tmp_path}/*.csv").collect()
        assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in whole)
    small_ranges(size)
    lines = flow_csv.quoted.byte_lines(spark, [f"{tmp_path}/*.csv"])
    assert size == "64m" or flow_csv.quoted.ranges_of(lines).filter("inside").count() > 5
    found = flow_csv.scan_csv(spark, [f"{tmp_path}/*.csv"], ["a", "b", "c"], encoding, True)
    rows = [(r[0], r[1], r[2], r[4]) for r in found.collect()]
    assert len(rows) == 1200
    assert sorted(map(repr, rows)) == sorted(map(repr, wanted))


def test_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n")
    (tmp_path / "b.csv").write_text('x,"y"')
    assert flow_csv.scan_csv(spark, [f"{tmp_path}/*.csv"], ["x", "y"], multi_line=True).count() == 0


def test_a_quote_that_never_closes_takes_the_rest(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,2\n3,"4\n5,6\n')
    rows = flow_csv.scan_csv(spark, [f"{tmp_path}/a.csv"], ["x", "y"], multi_line=True).collect()
    assert sorted(r[0] for r in rows) == ["1", "3"]
