"""Files in, files out."""

import datetime
import gzip

import pytest
from pyspark.sql import functions as F

from skyledger.schema import CONCATENATED_FILE
from skyledger.sources import csv_files, models, tables
from skyledger.sources.paths import EmptySourceError, matching_paths

HEADER = "datetime,main_aqi,components_pm2_5,components_so2,city\n"


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_types_and_missing_tokens(spark, tmp_path):
    path = _write(
        tmp_path / "a.csv",
        HEADER
        + "2021-08-01 05:00:00,4.0,1.5,NA,Lahore\n"
        + "junk,,NaN,nan,NA\n"
        + '8/13/2021 5:00,2,,7,"Dera ""G"" Khan, South"\n',
    )
    read = csv_files.read_csv(spark, path)
    assert dict(read.dtypes) == {
        "datetime": "string", "main_aqi": "int", "components_pm2_5": "double",
        "components_so2": "double", "city": "string",
    }
    assert [tuple(row) for row in read.collect()] == [
        ("2021-08-01 05:00:00", 4, 1.5, None, "Lahore"),
        ("junk", None, None, None, None),
        ("8/13/2021 5:00", 2, None, 7.0, 'Dera "G" Khan, South'),
    ]


def test_inference_is_opt_in_and_covers_undeclared_columns(spark, tmp_path):
    path = _write(tmp_path / "a.csv", "main_aqi,latitude,note,blank\n1,31.5,x,NA\n2,NA,7,\n3,1e1,,\n")
    assert dict(csv_files.read_csv(spark, path).dtypes)["latitude"] == "string"
    read = csv_files.read_csv(spark, path, infer=True)
    assert dict(read.dtypes) == {"main_aqi": "int", "latitude": "double", "note": "string", "blank": "double"}
    assert [row.latitude for row in read.orderBy("main_aqi").collect()] == [31.5, None, 10.0]


def test_pieces_with_other_columns_join_by_name(spark, tmp_path):
    _write(tmp_path / "x_complete_data.csv", HEADER + "2021-08-01,1,10,3,Lahore\n")
    _write(tmp_path / "y_complete_data.csv", "city,components_pm2_5,main_aqi,datetime\nQuetta,20,2,2021-08-02\n")
    _write(tmp_path / "z_complete_data.csv", HEADER + "2021-08-03,3,30,4,Karachi\n")
    rows = csv_files.read_training(spark, str(tmp_path)).orderBy("main_aqi").collect()
    assert [(r.city, r.components_pm2_5, r.components_so2) for r in rows] == [
        ("Lahore", 10.0, 3.0), ("Quetta", 20.0, None), ("Karachi", 30.0, 4.0),
    ]


def test_one_scan_per_header_not_per_file(spark, tmp_path):
    for place in range(12):
        header = HEADER if place % 2 else "datetime,main_aqi\n"
        line = "2021-08-01,1,10,3,Lahore\n" if place % 2 else "2021-08-01,1\n"
        _write(tmp_path / f"p{place}_complete_data.csv", header + line)
    read = csv_files.read_training(spark, str(tmp_path))
    assert read._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2
    assert read.count() == 12


def test_a_given_header_that_a_file_does_not_have_fails(spark, tmp_path):
    path = _write(tmp_path / "a.csv", "city,main_aqi\nLahore,1\n")
    read = csv_files.read_csv(spark, path, header=["main_aqi", "city"])
    with pytest.raises(Exception, match="(?i)header"):
        read.collect()


def test_the_concatenated_file_wins(spark, tmp_path):
    _write(tmp_path / "x_complete_data.csv", HEADER + "2021-08-01,1,10,3,Lahore\n")
    assert csv_files.read_training(spark, str(tmp_path)).count() == 1
    _write(tmp_path / CONCATENATED_FILE, HEADER + "2021-08-01,1,10,3,Lahore\n" * 5)
    assert csv_files.read_training(spark, str(tmp_path)).count() == 5


def test_no_input_is_an_error_before_planning(spark, tmp_path):
    for reader in (csv_files.read_training, csv_files.read_testing):
        with pytest.raises(EmptySourceError):
            reader(spark, str(tmp_path))
    with pytest.raises(EmptySourceError):
        tables.read_readings(spark, str(tmp_path / "absent"))
    with pytest.raises(EmptySourceError):
        csv_files.read_csv_glob(spark, str(tmp_path / "*.csv"))
    assert models.load_model(spark, str(tmp_path / "absent")) is None


def test_workbooks_are_refused_not_skipped(spark, tmp_path):
    _write(tmp_path / "x_complete_data.csv", HEADER + "2021-08-01,1,10,3,Lahore\n")
    _write(tmp_path / "y.xlsx", "")
    with pytest.raises(ValueError, match="y.xlsx"):
        csv_files.read_training(spark, str(tmp_path))


def test_csv_round_trip(spark, tmp_path):
    moments = [datetime.datetime(2021, 8, 1, 5), datetime.datetime(2021, 8, 1, 5, 0, 0, 250000)]
    rows = [(moments[0], 0.1 + 0.2, 'a "b", c'), (moments[1], None, None)]
    written = spark.createDataFrame(rows, "datetime timestamp_ntz, components_co double, city string")
    path = str(tmp_path / "out")
    csv_files.write_csv(written, path)
    csv_files.write_csv(written, path)
    text = sorted(line for part in matching_paths(spark, f"{path}/part*") for line in
                  spark.read.text(part).toPandas()["value"] if not line.startswith("datetime"))
    assert text[0].startswith("2021-08-01 05:00:00,") and text[1].startswith("2021-08-01 05:00:00.25")
    read = csv_files.read_csv(spark, path).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    assert sorted(map(tuple, read.collect())) == sorted(rows)


def test_readings_table_prunes_months_and_splits_a_hot_one(spark, tmp_path):
    rows = spark.range(60_000).select(
        "id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 12 + 1).cast("int").alias("month"),
        F.lit(2021).alias("year"), F.rand(1).alias("components_pm2_5"),
    )
    path = str(tmp_path / "table")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256KB")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16KB")
    try:
        tables.write_readings(rows.repartition(16), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    stored = tables.read_readings(spark, path)
    assert stored.count() == 60_000
    files = {month: len(matching_paths(spark, f"{path}/year=2021/month={month}/part*")) for month in range(1, 13)}
    assert files[1] > 1 and min(count for count in files.values() if count) == 1
    plan = stored.where((F.col("year") == 2021) & (F.col("month") == 2)).select("components_pm2_5")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in text and "ReadSchema: struct<components_pm2_5:double>" in text


def test_headers_of_many_pieces_start_no_jobs(spark, tmp_path):
    for k in range(200):
        (tmp_path / f"p{k:03d}_complete_data.csv").write_text("datetime,main_aqi\n2021-08-01,1\n" if k % 2 else "main_aqi,datetime\n1,2021-08-01\n")
    spark.sparkContext.setJobGroup("headers", "opening pieces")
    frame = csv_files.read_csv_glob(spark, f"{tmp_path}/*_complete_data.csv")
    # Spark lists many paths in a job of its own, one per distinct header; headers take none.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers")) <= 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert frame.where("main_aqi = 1").count() == 200


def test_header_forms(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffmain_aqi,"a,b",,x,X\n1,2,3,4,5\n')
    assert csv_files._header(spark, str(tmp_path / "a.csv")) == ("main_aqi", "a,b", "_c2", "x3", "X4")
    (tmp_path / "empty.csv").write_text("")
    assert csv_files._header(spark, str(tmp_path / "empty.csv")) == ()
    with gzip.open(tmp_path / "z.csv.gz", "wt") as file:
        file.write("q,r\n1,2\n")
    assert csv_files._header(spark, str(tmp_path / "z.csv.gz")) == ("q", "r")


LINES = "a,main_aqi,city\nx,1,Lahore\ny,2\nz\n\"p, q\",3\nu,4,Quetta,7\n\"open,5,Multan\nv,,\n"


def test_short_rows_keep_their_values(spark, tmp_path):
    sound = LINES.replace("u,4,Quetta,7\n", "").replace('"open,5,Multan\n', "")
    path = _write(tmp_path / "a.csv", sound)
    want = [("x", 1, "Lahore"), ("y", 2, None), ("z", None, None), ("p, q", 3, None), ("v", None, None)]
    assert [tuple(row) for row in csv_files.read_csv(spark, path).collect()] == want
    assert csv_files.read_csv(spark, path).count() == 5
    with pytest.raises(Exception, match="(?i)malformed"):
        csv_files.read_csv(spark, path, strict=True).collect()


def test_rows_with_surplus_fields_or_open_quotes_fail_or_are_kept(spark, tmp_path):
    path = _write(tmp_path / "a.csv", LINES)
    with pytest.raises(Exception, match="malformed CSV row"):
        csv_files.read_csv(spark, path).collect()
    with pytest.raises(Exception, match="malformed CSV row"):
        csv_files.read_csv_glob(spark, f"{tmp_path}/*.csv").count()
    kept = csv_files.read_csv(spark, path, trace=True)
    marks = {row.a: (row._malformed, row._short) for row in kept.collect()}
    assert {a for a, (text, _) in marks.items() if text} == {"u", "open,5,Multan"}
    assert marks["u"][0] == "u,4,Quetta,7" and {a for a, (_, short) in marks.items() if short} == {"y", "z", "p, q"}
    # Queries that need no column but the marks.
    assert kept.where("_malformed IS NOT NULL").count() == 2 and kept.where("_short").count() == 3


def test_pieces_are_judged_by_their_own_header(spark, tmp_path):
    _write(tmp_path / "x_complete_data.csv", "main_aqi,city\n1,Lahore\n")
    _write(tmp_path / "y_complete_data.csv", "main_aqi,city,components_co\n2,Quetta,5\n3,Multan\n")
    rows = csv_files.read_training(spark, str(tmp_path), trace=True).collect()
    assert sorted((r.main_aqi, r.components_co, r._short, r._malformed) for r in rows) == [
        (1, None, False, None), (2, 5.0, False, None), (3, None, True, None),
    ]


TEXTS = ["a\nb", "a\r\nb\r", "\\n", "\\", "\\\n", "\\s", "\\r\\s\\n", '"q", r\n"', " lead", "trail ", "x\\", "\n", "ü\u2028\x0b"]


def test_texts_with_line_breaks_come_back(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(place, text) for place, text in enumerate(TEXTS)]
    csv_files.write_csv(spark.createDataFrame(rows, "main_aqi int, city string").coalesce(1), path)
    part = matching_paths(spark, f"{path}/part*")[0]
    # Each row stays on its line, so a file can be split anywhere.
    assert spark.read.text(part).count() == len(TEXTS) + 1
    read = csv_files.read_csv(spark, path)
    assert sorted(map(tuple, read.collect())) == rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        split = csv_files.read_csv(spark, path)
        assert split.rdd.getNumPartitions() > 2 and sorted(map(tuple, split.collect())) == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_line_breaks_can_be_refused(spark, tmp_path):
    fine = spark.createDataFrame([("a\\nb",)], "city string")
    csv_files.write_csv(fine, str(tmp_path / "fine"), line_breaks="refuse")
    assert csv_files.read_csv(spark, str(tmp_path / "fine")).first().city == "a\\nb"
    with pytest.raises(Exception, match="line break in city"):
        csv_files.write_csv(spark.createDataFrame([("a\nb",)], "city string"), str(tmp_path / "x"), line_breaks="refuse")
    with pytest.raises(ValueError):
        csv_files.write_csv(fine, str(tmp_path / "y"), line_breaks="drop")


def test_backslashes_of_other_writers_stay(spark, tmp_path):
    path = _write(tmp_path / "a.csv", "city,main_aqi\nC:\\new\\road\\s,1\n")
    assert csv_files.read_csv(spark, path).first().city == "C:\\new\\road\\s"


def test_the_city_of_a_piece_that_a_partitioned_write_made(spark, tmp_path):
    rows = [(1, "Dera-G_complete_data.csv"), (2, "Lahore_complete_data.csv"), (3, "Lahore_complete_data.csv")]
    frame = spark.createDataFrame(rows, "main_aqi int, piece string")
    frame.write.partitionBy("piece").option("header", True).csv(f"{tmp_path}/pieces")
    _write(tmp_path / "pieces" / "Quetta_complete_data.csv", "main_aqi\n4\n")
    read = csv_files.read_training(spark, f"{tmp_path}/pieces", city_of_file=True)
    assert sorted((r.main_aqi, r._city) for r in read.collect()) == [(1, "Dera-G"), (2, "Lahore"), (3, "Lahore"), (4, "Quetta")]
