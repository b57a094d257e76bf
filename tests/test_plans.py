"""The whole chain on CSV folders, and how it behaves on skewed keys."""

from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import oracle_check
from skyledger import session
from skyledger.__main__ import main
from skyledger.operators.clean import drop_copies
from skyledger.operators.forest import evaluate, predict
from skyledger.plans.dashboard import current_baselines, live_dashboard
from skyledger.plans.preprocess import preprocess
from skyledger.plans.training import train_and_evaluate
from skyledger.registry import inputs
from skyledger.registry.oracle import all_oracles
from skyledger.schema import DEFAULT_BASELINES
from skyledger.sources.csv_files import read_csv, write_csv
from skyledger.sources.driver_tables import readings_view
from skyledger.sources.models import load_model
from skyledger.sources.paths import path_exists, qualified_path
from skyledger.sources.tables import read_features, read_readings


@pytest.fixture(scope="module")
def prepared(spark, small, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("chain"))
    text = inputs.text_readings(spark, small)
    is_test = F.col("reading_id").cast("long") % 5 == 0
    write_csv(text.where(~is_test & (F.col("city") == "ASIA")), f"{root}/train/asia_complete_data.csv")
    write_csv(text.where(~is_test & ~F.col("city").eqNullSafe("ASIA")), f"{root}/train/rest_complete_data.csv")
    write_csv(text.where(is_test), f"{root}/test/all.csv")
    return root, preprocess(spark, f"{root}/train", f"{root}/test", f"{root}/out")


def test_preprocess_tables_agree_with_each_other(spark, prepared):
    _, done = prepared
    readings = read_readings(spark, done.train_readings)
    report = done.train_report.first()
    assert report.clean_rows == readings.count() == read_csv(spark, done.train_csv).count()
    assert report.initial_rows > report.clean_rows
    # Missing labels and copies are all in the test part.
    other = done.test_report.first()
    assert other.initial_rows > other.labelled_rows > other.unique_rows > other.clean_rows
    incomplete = done.train_incomplete.first()
    assert incomplete.incomplete_rows == readings.where("components_so2 IS NULL").count() > 0
    assert read_features(spark, done.train_features).count() == incomplete.n_rows - incomplete.incomplete_rows
    assert read_features(spark, done.test_features).columns == ["features", "main_aqi"]
    assert set(dict(read_csv(spark, done.test_csv).dtypes)) >= {"hour", "month", "year", "main_aqi"}


def test_train_evaluate_save(spark, prepared):
    root, done = prepared
    trained = train_and_evaluate(spark, done.train_features, done.test_features, f"{root}/model", 8)
    assert trained.accuracy > 0.8 and 0.7 < trained.weighted_f1 <= 1
    loaded = load_model(spark, f"{root}/model")
    again = evaluate(predict(loaded, read_features(spark, done.test_features))).first()
    assert (again.accuracy, again.weighted_f1) == (trained.accuracy, trained.weighted_f1)


def test_dashboard_and_baselines_of_a_table_and_of_none(spark, prepared):
    root, done = prepared
    board = live_dashboard(spark, done.train_readings).first()
    assert board.status == "success" and len(board.labels) == len(board.real_pm25) > 12
    assert live_dashboard(spark, f"{root}/absent").first().status == "fallback"
    assert current_baselines(spark, done.train_readings, 90.0).first().model_accuracy == 90.0
    assert current_baselines(spark, f"{root}/absent").first().asDict() == DEFAULT_BASELINES


def test_jobs_of_the_command_line(spark, prepared, tmp_path, capsys):
    root, done = prepared
    out = str(tmp_path)
    requests = f"{out}/requests"
    inputs.requests(spark, "/root/testdata/sf0.001").drop(*inputs.KEYS).write.json(requests)
    main(["preprocess", "--train", f"{root}/train", "--test", f"{root}/test", "--output", f"{out}/tables"])
    main(["train", "--train-features", f"{out}/tables/train_features", "--test-features",
          f"{out}/tables/test_features", "--model", f"{out}/model"])
    assert "accuracy 0." in capsys.readouterr().out
    main(["dashboard", "--readings", f"{out}/tables/train_readings", "--output", f"{out}/board"])
    assert spark.read.json(f"{out}/board").first().status == "success"
    common = ["--requests", requests, "--readings", done.train_readings, "--model", f"{out}/model"]
    main(["score", *common, "--output", f"{out}/answers"])
    main(["stream", *common, "--output", f"{out}/streamed", "--checkpoint", f"{out}/progress"])
    batch, streamed = spark.read.parquet(f"{out}/answers"), spark.read.parquet(f"{out}/streamed")
    assert batch.count() == streamed.count() == spark.read.json(requests).count()
    assert batch.exceptAll(streamed).isEmpty()


def test_scratch_needs_a_shared_folder_off_a_local_master():
    class Session:
        def __init__(self, master, folder=None):
            self.sparkContext = SimpleNamespace(master=master)
            self.conf = {"spark.checkpoint.dir": folder} if folder else {}

    assert session.scratch_root(Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Session("spark://host:7077"))


def test_scratch_without_a_shared_folder_is_on_the_default_file_system(spark):
    local = SimpleNamespace(sparkContext=spark.sparkContext, conf={})
    assert session.scratch_root(local) == qualified_path(spark, "/tmp") == "file:/tmp"


def test_scratch_follows_the_session(spark):
    assert session.scratch_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert session.scratch_folder(spark, "x") != session.scratch_folder(spark, "x")


@pytest.fixture(scope="module")
def skewed(tmp_path_factory, small):
    """The small tables, with a third of all line items on one order."""
    folder = tmp_path_factory.mktemp("skewed")
    for name in oracle_check.TABLES:
        table = pq.read_table(f"{small}/{name}.parquet")
        if name == "lineitem":
            table = pa.concat_tables([table] * 20)
            keys = table["l_orderkey"].to_pylist()
            hot = keys[0]
            keys = [hot if place % 3 == 0 else key for place, key in enumerate(keys)]
            table = table.set_column(table.column_names.index("l_orderkey"), "l_orderkey", pa.array(keys, pa.int64()))
        pq.write_table(table, folder / f"{name}.parquet", row_group_size=10_000)
    return str(folder)


def test_results_hold_and_the_join_splits_where_one_key_has_a_third(spark, skewed):
    small_parts = {
        # Several map tasks, as only what different tasks wrote can be split.
        "spark.sql.files.maxPartitionBytes": "256KB",
        "spark.sql.files.openCostInBytes": "1KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for key, value in small_parts.items():
        spark.conf.set(key, value)
    try:
        unique = drop_copies(readings_view(session.tune(spark), skewed))
        sql = all_oracles()["full_row_dedup"]
        assert oracle_check.difference(unique, oracle_check.connect(skewed), sql) is None
        unique.write.format("noop").mode("overwrite").save()
        unique.collect()
        assert "skew=true" in unique._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in small_parts:
            spark.conf.unset(key)


def test_a_piece_without_a_column_does_not_vanish_unnoticed(spark, small, tmp_path):
    root, text = str(tmp_path), inputs.text_readings(spark, small).where("reading_id % 12 = 0")
    write_csv(text, f"{root}/train/a_complete_data.csv")
    write_csv(text.drop("components_so2"), f"{root}/train/b_complete_data.csv")
    write_csv(text, f"{root}/test/all.csv")
    with pytest.raises(ValueError, match="b_complete_data.csv lacks components_so2"):
        preprocess(spark, f"{root}/train", f"{root}/test", f"{root}/out")
    done = preprocess(spark, f"{root}/train", f"{root}/test", f"{root}/kept", handle_invalid="keep")
    assert read_features(spark, done.train_features).count() == read_readings(spark, done.train_readings).count()


def test_a_plain_path_is_no_glob(spark, tmp_path):
    (tmp_path / "run[1]").mkdir()
    assert path_exists(spark, str(tmp_path / "run[1]"))
    assert not path_exists(spark, str(tmp_path / "run*"))
