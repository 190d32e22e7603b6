from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowbench.config import DetectorConfig
from flowbench.operators import projection
from flowbench.operators.metrics import metrics_record
from flowbench.plans import detector, report
from flowbench.sources import tables

SMALL = DetectorConfig(rff_components=24, rotations=3, trees=12, max_depth=7)


@pytest.fixture(scope="module")
def rows():
    """Benign flows near one centre, attacks far from it; every part of the split has both."""
    rng = np.random.default_rng(5)
    benign, attacks = 1500, 300
    frame = pd.DataFrame(
        rng.normal(0, 1, (benign + attacks, 4)), columns=[f"Metric {i}" for i in range(4)]
    )
    frame.iloc[benign:, :4] += rng.choice([-9, 9], (attacks, 4))
    frame["Protocol"] = rng.choice(["tcp", "udp"], len(frame))
    frame[" Label"] = ["BENIGN"] * benign + ["Bot"] * attacks
    days = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]
    frame["source_file"] = [f"{days[i % 5]}.csv" for i in range(len(frame))]
    frame.columns = [c.strip().lower().replace(" ", "_") for c in frame.columns]
    return frame


@pytest.fixture(scope="module")
def flows(spark, rows):
    return tables.write_table(spark.createDataFrame(rows), "flows")


@pytest.fixture(scope="module")
def run(flows):
    from flowbench.operators.split import benign_part, part, split_rows

    frame = split_rows(flows)
    return detector.run_detector(
        benign_part(frame, "train"), benign_part(frame, "val"), part(frame, "test"), SMALL
    )


def test_attacks_stand_out(run):
    record = metrics_record(run.scored, score="score").first()
    assert record.roc_auc > 0.9 and record.pr_auc > 0.6
    assert record.tn + record.fp + record.fn + record.tp == run.scored.count() == 720


def test_threshold_is_the_benign_quantile(run, flows):
    from flowbench.operators.split import benign_part, split_rows

    fitted = run.detector
    assert fitted.threshold == fitted.derived_threshold
    scores = fitted.score(benign_part(split_rows(flows), "train")).toPandas().score
    assert fitted.threshold == pytest.approx(np.quantile(scores, 0.97), rel=1e-12)
    assert 0.95 < (scores <= fitted.threshold).mean() <= 0.99
    assert fitted.training_seconds > 0 and fitted.validation_seconds > 0 and run.test_seconds > 0


def test_saved_detector_scores_alike(spark, run, flows, tmp_path):
    path = detector.save_detector(run.detector, str(tmp_path / "deep" / "model"))
    again = detector.load_detector(spark, path)
    assert again.config == run.detector.config and again.info == run.detector.info
    before = run.detector.predict(flows, ["source_file"]).orderBy("score").toPandas()
    after = again.predict(flows, ["source_file"]).orderBy("score").toPandas()
    assert np.allclose(before.score, after.score, rtol=0, atol=1e-9)
    assert (before.prediction == after.prediction).all()


def test_calibrated_threshold(flows):
    config = DetectorConfig(
        rff_components=8, rotations=2, trees=2, max_depth=2, use_calibrated_threshold=True
    )
    fitted = detector.fit_detector(flows.filter("label = 'BENIGN'"), config=config)
    assert fitted.threshold == 0.8042 and fitted.derived_threshold != 0.8042


def test_same_seed_same_detector(flows):
    config = DetectorConfig(rff_components=8, rotations=2, trees=3, max_depth=3)
    benign = flows.filter("label = 'BENIGN'")
    first, second, other = (
        detector.fit_detector(benign, config=config, seed=s).derived_threshold for s in (1, 1, 2)
    )
    assert first == second != other


def test_unfitted_and_unbounded(run):
    from dataclasses import replace

    with pytest.raises(ValueError, match="fit the detector first"):
        replace(run.detector, threshold=None).predict(run.scored)
    for depth in (None, 31):
        with pytest.raises(ValueError, match="max_depth"):
            DetectorConfig(max_depth=depth)


def test_wide_detector_can_be_saved(spark, flows, tmp_path):
    config = DetectorConfig(
        rff_components=8, rotations=2, trees=2, max_depth=3, svd_components=3, inline_width=6
    )
    many = flows.withColumn("port", (F.xxhash64("metric_0") % 1500).cast("string"))
    fitted = detector.fit_detector(many.filter("label = 'BENIGN'"), config=config)
    assert fitted.transform.features.wide
    again = detector.load_detector(spark, detector.save_detector(fitted, str(tmp_path / "m")))
    difference = [
        s.agg(F.sum("score")).first()[0] for s in (fitted.score(many), again.score(many))
    ]
    assert difference[0] == pytest.approx(difference[1], rel=1e-9)


def test_sweep(spark, flows, tmp_path):
    output = str(tmp_path / "runs")
    config = DetectorConfig(rff_components=8, rotations=2, trees=2, max_depth=3)
    result = report.run_sweep(
        flows, ["baseline", "parse_norm_clean"], [1, 2], config, output=output,
        model_folder=str(tmp_path / "models"),
    )
    rows = result.orderBy("variant", "seed").collect()
    assert [(r.variant, r.seed) for r in rows] == [
        ("baseline", 1), ("baseline", 2), ("parse_norm_clean", 1), ("parse_norm_clean", 2),
    ]
    assert spark.read.parquet(output).count() == 4
    for row in rows:
        assert row.model == "rf_anomaly" and row.n_features == 5
        assert (row.train_rows_before, row.val_rows_before, row.test_rows_after) == (720, 360, 720)
        assert row.train_columns_before == 6
        assert row.tn + row.fp + row.fn + row.tp == row.test_rows_after
        assert detector.load_detector(spark, row.model_path).threshold == row.threshold


def test_a_sweep_run_again_replaces_its_records(spark, flows, tmp_path, monkeypatch):
    output, models = str(tmp_path / "runs"), str(tmp_path / "models")
    config = DetectorConfig(rff_components=4, rotations=2, trees=1, max_depth=2)
    ran = []
    whole = report.run_variant

    def ends_after_two(*args, **kwargs):
        if len(ran) == 2:
            raise KeyboardInterrupt
        ran.append(args[1:3])
        return whole(*args, **kwargs)

    def sweep(**options):
        return report.run_sweep(flows, ["baseline", "parse"], [1, 2], config, output=output, model_folder=models, **options)

    monkeypatch.setattr(report, "run_variant", ends_after_two)
    with pytest.raises(KeyboardInterrupt):
        sweep()
    assert spark.read.parquet(output).count() == 2
    monkeypatch.setattr(report, "run_variant", lambda *a, **k: ran.append(a[1:3]) or whole(*a, **k))
    assert sweep(resume=True).count() == 4 and len(ran) == 4
    assert spark.read.parquet(output).count() == 4
    first = spark.read.parquet(output).select("variant", "seed").orderBy("variant", "seed").collect()
    assert [tuple(r) for r in first] == [("baseline", 1), ("baseline", 2), ("parse", 1), ("parse", 2)]
    report.run_sweep(flows, ["baseline"], [1], config, output=output, model_folder=models)
    assert len(ran) == 5 and spark.read.parquet(output).count() == 4


def test_runs_side_by_side_give_the_same_records(spark, flows, tmp_path):
    config = DetectorConfig(rff_components=4, rotations=2, trees=2, max_depth=3)
    facts = []
    for concurrent in (1, 2):
        folder = str(tmp_path / str(concurrent))
        found = report.run_sweep(
            flows, ["baseline"], [1, 2], config, output=folder, model_folder=f"{folder}-models", concurrent=concurrent
        )
        assert found.filter("training_time > 0 and validation_scoring_time > 0 and test_scoring_time > 0").count() == 2
        timed = ("training_time", "validation_scoring_time", "test_scoring_time", "model_path")
        facts.append(sorted(found.drop(*timed).collect()))
    assert facts[0] == facts[1]
    with pytest.raises(ZeroDivisionError):
        report.side_by_side(spark, lambda n: 1 // n, [1, 0, 2], 2)


def test_a_save_that_breaks_off_leaves_the_model_before(spark, flows, tmp_path, monkeypatch):
    config = DetectorConfig(rff_components=4, rotations=2, trees=1, max_depth=2)
    fitted = detector.fit_detector(flows.filter("label = 'BENIGN'"), config=config)
    path = detector.save_detector(fitted, str(tmp_path / "m"))
    other = replace(fitted, threshold=-1.0)
    write = detector._save

    def breaks_off(spark, rows, schema, folder):
        if folder.endswith("matrices"):
            raise OSError("broken off")
        write(spark, rows, schema, folder)

    monkeypatch.setattr(detector, "_save", breaks_off)
    with pytest.raises(OSError):
        detector.save_detector(other, path)
    assert detector.load_detector(spark, path).threshold == fitted.threshold
    monkeypatch.undo()
    detector.save_detector(other, path)
    assert detector.load_detector(spark, path).threshold == -1.0
    with pytest.raises(FileNotFoundError):
        detector.load_detector(spark, str(tmp_path / "none"))


class Session:
    """Stands in for a session whose settings cannot change while it runs."""

    def __init__(self, settings, master):
        self.conf = settings
        self.sparkContext = type("Context", (), {"master": master})


def test_shared_folder_is_the_configured_one():
    named = {tables.CHECKPOINT_DIR: "hdfs:///shared/"}
    assert tables.shared_folder(Session(named, "yarn")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session({}, "yarn"))
    local = tables.shared_folder(Session({}, "local[2]"))
    assert local == tables.shared_folder(Session({}, "local[2]"))


def test_the_layout_follows_from_the_rows(spark, flows):
    """Neither the order, the partitions nor the files of the input change the fitted detector."""
    config = DetectorConfig(rff_components=8, rotations=2, trees=3, max_depth=3)
    benign = flows.filter("label = 'BENIGN'")
    laid = [benign.coalesce(1), benign.repartition(7, "metric_1"), benign.orderBy(F.desc("metric_0"))]
    found = {detector.fit_detector(frame, config=config, seed=1).threshold for frame in laid}
    assert len(found) == 1


def test_bounded_fit_keeps_statistics_and_threshold_on_all_rows(flows):
    benign = flows.filter("label = 'BENIGN'")
    bounded = DetectorConfig(rff_components=8, rotations=2, trees=3, max_depth=3, max_fit_rows=300)
    every = DetectorConfig(rff_components=8, rotations=2, trees=3, max_depth=3, max_fit_rows=None)
    few, full = (detector.fit_detector(benign, config=c) for c in (bounded, every))
    assert full.fit_rows == 1500 and 200 < few.fit_rows < 400 and few.info["n_fit_rows"] == few.fit_rows
    assert few.transform.features == full.transform.features
    scores = few.score(benign).toPandas().score
    assert len(scores) == 1500 and few.threshold == pytest.approx(np.quantile(scores, 0.97), rel=1e-12)


def test_equal_rows_are_drawn_and_laid_out_one_by_one(spark, monkeypatch):
    """Half of the rows are one row: it is half of the sample, spread over tasks; files do not matter."""
    monkeypatch.setattr(detector, "COPIES", 64)
    vector = F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.col("id") / 7, F.lit(0.0)))
    rows = spark.range(20_000).select(vector.cast("array<float>").alias("features"))
    every = detector.fit_sample(rows, None)
    assert every.count() == 20_000 and every.distinct().count() == 20_000
    assert every.select("features").exceptAll(rows).isEmpty()
    few = [detector.fit_sample(frame, 4000) for frame in (rows, rows.repartition(7).orderBy(F.desc("features")))]
    assert few[0].exceptAll(few[1]).isEmpty() and few[1].exceptAll(few[0]).isEmpty()
    hot = few[0].filter(F.col("features")[1] == 2).count()
    assert 3700 < few[0].count() < 4300 and 1800 < hot < 2200
    monkeypatch.setattr(detector, "BROADCAST_ROWS", 0)
    assert detector.fit_sample(rows, 4000).exceptAll(few[0]).isEmpty()
    sizes = [r["count"] for r in tables.laid_out(few[0], 400).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 5 and max(sizes) < 2 * min(sizes)
    assert detector.fit_sample(rows.limit(0), 4000).count() == 0


def test_no_table_of_rows_is_broadcast(spark, monkeypatch):
    """The driver holds no more than a bounded number of hashes, whether all rows grow the forest or some."""
    rows = spark.range(120_000).select(F.array(F.col("id").cast("float")).alias("features"))
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda frame: sent.append(frame.count()) or broadcast(frame))
    assert detector.fit_sample(rows, None).count() == detector.fit_sample(rows, 120_000).count() == 120_000
    many = detector.fit_sample(rows, 90_000)
    assert not sent and 88_000 < many.count() < 92_000 and many.select("features").exceptAll(rows).isEmpty()
    few = detector.fit_sample(rows, 500)
    assert sent == [few.count()] and 400 < sent[0] < 600
    assert few.exceptAll(many).isEmpty()  # the smaller draw is part of the larger one


@pytest.mark.parametrize("name", ["key", "listed", "n0", "c0", "probability", "flow_vector", "class_probability"])
def test_kept_columns_may_have_any_name(flows, name):
    config = DetectorConfig(
        rff_components=4, rotations=2, trees=1, max_depth=2, svd_components=3, inline_width=6
    )
    many = flows.withColumn("port", (F.xxhash64("metric_0") % 300).cast("string"))
    fitted = detector.fit_detector(many.filter("label = 'BENIGN'"), config=config)
    named = many.withColumn(name, F.col("source_file"))
    got = fitted.predict(named, [name, "source_file"])
    assert got.columns == [name, "source_file", "score", "prediction"]
    assert got.filter(F.col(name) != F.col("source_file")).count() == 0 and got.count() == many.count()


def test_a_value_that_only_the_scored_rows_have_may_flood(flows):
    """Most rows to score share one value that training never saw."""
    config = DetectorConfig(
        rff_components=4, rotations=2, trees=1, max_depth=2, svd_components=3, inline_width=6
    )
    many = flows.withColumn("port", (F.xxhash64("metric_0") % 300).cast("string"))
    fitted = detector.fit_detector(many.filter("label = 'BENIGN'"), config=config)
    flooded = many.withColumn("port", F.when(F.rand(1) < 0.9, "new").otherwise(F.col("port")))
    assert fitted.score(flooded).filter("score is not null").count() == many.count()


def test_rotated_rows_come_as_vectors(spark, monkeypatch):
    """The forest reads the rotated values as vectors of the same numbers, without converting row by row."""
    matrices = projection.rotation_matrices(3, 2, 5)
    rows = spark.range(60).select(F.array(*[(F.col("id") * k % 7 / 3).cast("float") for k in (1, 2, 4)]).alias("features"), F.lit(0).alias("copy"))
    rows = tables.write_table(rows, "rows")
    plain = projection.rotate(rows, matrices).select("rotation", F.col("features").cast("array<double>"))
    vectors = projection.rotate(rows, matrices, vectors=True).select("rotation", vector_to_array("features").alias("features"))
    assert vectors.exceptAll(plain).isEmpty() and plain.exceptAll(vectors).isEmpty() and plain.count() == 120
    assert projection.rotate(rows.limit(0), matrices, vectors=True).count() == 0
    monkeypatch.setattr(detector, "array_to_vector", None)
    config = DetectorConfig(rff_components=3, rotations=2, trees=2, max_depth=3)
    assert detector.fit_forest(rows, matrices, config, 5).numFeatures == 3
