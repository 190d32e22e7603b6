import pytest

from flowbench.operators import split

DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]


@pytest.fixture(scope="module")
def flows(spark):
    names = [f"{day.upper()}-x.csv" for day in DAYS] + ["friday-and-monday.csv", "notes.csv"]
    rows = [(i, name, "BENIGN" if i % 2 == 0 else "Bot") for i, name in enumerate(names * 3)]
    return spark.createDataFrame(rows, "id int, source_file string, label string")


def test_first_weekday_in_the_name_wins(flows):
    found = {r.source_file: r.weekday for r in split.with_weekday(flows).collect()}
    assert found["friday-and-monday.csv"] == "Monday"
    assert found["notes.csv"] is None and found["THURSDAY-x.csv"] == "Thursday"


def test_parts_are_disjoint_and_complete(flows):
    rows = split.split_rows(flows)
    counts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    assert counts == {"train": 9, "val": 3, "test": 6}
    assert rows.select("id").distinct().count() == rows.count() == 18


def test_weekday_files_and_subset(flows):
    files = {(r.weekday, r.source_file): r.rows for r in split.weekday_files(flows).collect()}
    assert len(files) == 6 and set(files.values()) == {3}
    monday = [r.source_file for r in split.source_files_of(flows, ["Monday"]).collect()]
    assert sorted(monday) == ["MONDAY-x.csv", "friday-and-monday.csv"]
    assert split.subset_by_source_files(flows, monday).count() == 6
    assert split.subset_by_source_files(flows, []).count() == 0


def test_benign_part(flows):
    rows = split.benign_part(split.split_rows(flows), "train").collect()
    assert rows and all(r.target == 0 and r.split == "train" for r in rows)


def test_errors(flows):
    with pytest.raises(ValueError, match="No source file for: Tuesday, Friday"):
        split.check_weekdays(flows.filter("not lower(source_file) rlike 'tuesday|friday'"))
    for function in (split.with_weekday, split.check_weekdays):
        with pytest.raises(ValueError, match="no column 'source_file'"):
            function(flows.drop("source_file"))


def test_stored_split_reads_only_its_own_part(flows):
    stored = split.store_split(flows)
    assert stored.count() == 18
    part = split.part(split.split_rows(stored, check=False), "val")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "= val)" in plan
    assert part.count() == 3
