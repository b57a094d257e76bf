"""Forest, its metrics, and its repeatability."""

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from skyledger.operators import features, forest
from skyledger.registry import inputs
from skyledger.sources.driver_tables import train_split
from skyledger.sources.models import load_model, save_model
from skyledger.sources.tables import read_features, write_features


@pytest.fixture(scope="module")
def training(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("forest") / "features")
    write_features(features.assemble(train_split(inputs.clean(spark, small))), path)
    return read_features(spark, path)


@pytest.fixture(scope="module")
def model(training):
    return forest.fit_forest(training)


def _trees(model):
    return [tree.toDebugString.split("\n", 1)[1] for tree in model.trees]


def test_shape_and_quality(spark, small, model):
    assert (model.getNumTrees, model.getMaxDepth(), model.numFeatures, model.numClasses) == (15, 5, 11, 6)
    assert max(tree.depth for tree in model.trees) <= 5
    scored = forest.predict(model, inputs.test_vectors(spark, small)).cache()
    metrics = forest.evaluate(scored).first()
    assert metrics.accuracy > 0.8
    as_double = scored.select(F.col("main_aqi").cast("double"), F.col("prediction").cast("double"))
    for name, value in (("accuracy", metrics.accuracy), ("f1", metrics.weighted_f1)):
        evaluator = MulticlassClassificationEvaluator(labelCol="main_aqi", metricName=name)
        assert evaluator.evaluate(as_double) == pytest.approx(value, abs=1e-12)
    assert metrics.n_rows == scored.count()


def test_metrics_where_a_class_is_never_right(spark):
    pairs = [(1, 1)] * 5 + [(2, 1)] * 2 + [(3, 2)] + [(4, 4)] * 3 + [(1, 5)]
    frame = spark.createDataFrame(pairs, "main_aqi int, prediction int")
    metrics = forest.evaluate(frame).first()
    as_double = frame.select(*[F.col(name).cast("double") for name in frame.columns])
    for name, value in (("accuracy", metrics.accuracy), ("f1", metrics.weighted_f1)):
        evaluator = MulticlassClassificationEvaluator(labelCol="main_aqi", metricName=name)
        assert evaluator.evaluate(as_double) == pytest.approx(value, abs=1e-12)


def test_saving_twice_and_loading_changes_no_prediction(spark, small, model, tmp_path):
    path = str(tmp_path / "model")
    save_model(model, path)
    save_model(model, path)
    assert _trees(load_model(spark, path)) == _trees(model)


def test_a_repeatable_fit_does_not_depend_on_how_rows_lie(training):
    first = forest.fit_forest(training, repeatable_partitions=4)
    again = forest.fit_forest(training.repartition(7), repeatable_partitions=4)
    assert _trees(first) == _trees(again)


def test_repeatable_order_keeps_every_copy_and_spreads_a_hot_vector(spark):
    n_hot = 5 * forest.COPIES_PER_CHUNK + 17
    hot = spark.range(n_hot).select(F.lit(1.0).alias("x"), F.lit(3).alias("main_aqi"))
    cold = spark.range(500).select(F.col("id").cast("double").alias("x"), F.lit(2).alias("main_aqi"))
    rows = hot.union(cold).select(array_to_vector(F.array("x")).alias("features"), "main_aqi")
    placed = forest.in_repeatable_order(rows, 16)
    counts = placed.groupBy("main_aqi").count().collect()
    assert {row.main_aqi: row["count"] for row in counts} == {3: n_hot, 2: 500}
    sizes = placed.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) == 16
    assert max(row["count"] for row in sizes) <= 4 * forest.COPIES_PER_CHUNK
    assert placed.columns == ["features", "main_aqi"]


def test_prediction_stays_on_the_jvm(spark, small, model):
    plan = forest.predict(model, inputs.test_vectors(spark, small))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in text
    row = plan.agg(F.min("prediction"), F.max("prediction"), F.min("confidence"), F.max("confidence")).first()
    assert 0 <= row[0] and row[1] <= 5 and 0 < row[2] and row[3] <= 1


def _with_copies(vectors, often):
    """Every third row stands ``often`` times."""
    copies = F.when(F.xxhash64("main_aqi", F.col("features").cast("string")) % 3 == 0, often).otherwise(1)
    return vectors.select("features", "main_aqi", F.explode(F.array_repeat(F.lit(1), copies)).alias("c")).drop("c")


def test_counted_rows_give_the_trees_of_all_rows(spark, training, tmp_path):
    everything = _with_copies(training, forest.PIECES)
    write_features(forest.counted_rows(everything), str(tmp_path / "counted"))
    counted = read_features(spark, str(tmp_path / "counted"))
    assert counted.count() < everything.count() == counted.agg(F.sum(forest.WEIGHT)).first()[0]
    fits = [forest.fit_forest(frame, num_trees=3, repeatable_partitions=5) for frame in (everything, counted)]
    assert _trees(fits[0]) == _trees(fits[1])


def test_many_copies_are_fitted_as_few_weighted_rows(spark, small, training):
    counted = forest.counted_rows(_with_copies(training, 500))
    pieces = forest.in_pieces(counted, forest.PIECES)
    assert pieces.groupBy("features", "main_aqi").count().agg(F.max("count")).first()[0] <= forest.PIECES
    total = counted.agg(F.sum(forest.WEIGHT)).first()[0]
    assert pieces.agg(F.sum(forest.WEIGHT)).first()[0] == pytest.approx(total)
    weighted = forest.fit_forest(counted, repeatable_partitions=4)
    test = inputs.test_vectors(spark, small)
    assert forest.evaluate(forest.predict(weighted, test)).first().accuracy > 0.75


def test_partitions_grow_with_the_table_and_the_fit_still_repeats(training, monkeypatch):
    monkeypatch.setattr(forest, "ROWS_PER_PARTITION", 300)
    used = []
    placed = forest.in_repeatable_order
    monkeypatch.setattr(forest, "in_repeatable_order", lambda rows, n: used.append(n) or placed(rows, n))
    fits = [
        forest.fit_forest(frame, num_trees=2, repeatable_partitions=4)
        for frame in (training, training.repartition(7), forest.counted_rows(training))
    ]
    assert used == [-(-training.count() // 300)] * 3 and used[0] > 4
    assert _trees(fits[0]) == _trees(fits[1]) == _trees(fits[2])


def test_the_order_compares_numbers_before_values(training):
    plan = forest.in_repeatable_order(training, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [__place" in plan


def test_a_label_that_is_no_class_is_refused(training):
    with pytest.raises(Exception, match="(?i)label"):
        forest.fit_forest(training.withColumn("main_aqi", F.lit(2.5)), num_trees=1)


def test_rows_are_placed_once_for_all_passes_of_a_fit(training, monkeypatch):
    plans = []
    fit = forest.RandomForestClassifier.fit
    seen = lambda self, rows: plans.append(rows._jdf.queryExecution().withCachedData().toString()) or fit(self, rows)
    monkeypatch.setattr(forest.RandomForestClassifier, "fit", seen)
    forest.fit_forest(training, num_trees=1, repeatable_partitions=4)
    assert "InMemoryRelation" in plans[0]
    assert training.sparkSession.sparkContext._jsc.getPersistentRDDs().isEmpty()


def _many_and_few(spark):
    """Different rows, of which a few stand more often than a chunk may have copies."""
    rows = spark.range(300).select(F.array(F.col("id") * 0.5, F.lit(1.0)).alias("x"), (F.col("id") % 5).cast("int").alias("main_aqi"),
                                   F.explode(F.array_repeat(F.lit(1), F.when(F.col("id") % 50 == 0, 8).otherwise(1))))
    return rows.select(array_to_vector("x").alias("features"), "main_aqi")


def _in_place(rows):
    return [(row.p, row.main_aqi, tuple(row.features)) for row in rows.select("*", F.spark_partition_id().alias("p")).collect()]


def test_rows_fall_the_same_whether_all_are_counted_or_only_crowded_ones(spark, monkeypatch):
    monkeypatch.setattr(forest, "COPIES_PER_CHUNK", 3)
    monkeypatch.setattr(forest, "BUCKETS", 1024)
    rows = _many_and_few(spark)
    some = _in_place(forest.in_repeatable_order(rows, 4))
    found = []
    monkeypatch.setattr(forest, "_crowded", lambda *_: found.append(1) or list(range(1024)))
    every = _in_place(forest.in_repeatable_order(rows, 4))
    assert found and some == every and len(some) == rows.count() == 342


def test_rows_that_are_all_different_are_shuffled_once(spark):
    rows = spark.range(2000).select(array_to_vector(F.array(F.col("id") * 0.5)).alias("features"), F.lit(1).alias("main_aqi"))
    placed = forest.in_repeatable_order(rows, 4)
    assert placed._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 0
    assert len(set(_in_place(placed))) == 2000


def test_no_shuffle_of_the_placing_is_left_when_the_fit_starts(training, monkeypatch, shuffle_files):
    before, left = shuffle_files(), []
    fit = forest.RandomForestClassifier.fit
    monkeypatch.setattr(forest.RandomForestClassifier, "fit", lambda self, rows: left.append(shuffle_files(before)) or fit(self, rows))
    forest.fit_forest(training, num_trees=1, repeatable_partitions=4)
    assert left == [set()]
