"""A cleaning pass whose tasks fail and run again, compared with the report of the plan.

Run in a process of its own: the master is one that tries a task four times.
"""

import json
import sys

from pyspark import TaskContext
from pyspark.sql import SparkSession

from skyledger.operators.clean import cleaning_report, report_of_outcomes, sort_out
from skyledger.sources.csv_files import read_csv
from skyledger.sources.tables import read_outcomes, read_readings, write_outcomes


def failing_at_first(batches):
    """All rows; after the last one, the first attempt of each even task fails."""
    yield from batches
    context = TaskContext.get()
    if context.attemptNumber() == 0 and context.partitionId() % 2 == 0:
        raise RuntimeError("lost")


def main(folder: str) -> None:
    spark = (
        SparkSession.builder.master("local[4,4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.files.maxPartitionBytes", "4000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    raw = read_csv(spark, f"{folder}/raw.csv", trace=True)
    lossy = raw.mapInArrow(failing_at_first, raw.schema)
    # Fails while it reads, and again while it writes.
    rows = sort_out(lossy)
    write_outcomes(rows.mapInArrow(failing_at_first, rows.schema), f"{folder}/rows")
    written = read_outcomes(spark, f"{folder}/rows")
    answer = {
        "committed": report_of_outcomes(written).first().asDict(),
        "plan": cleaning_report(raw).first().asDict(),
        "clean": read_readings(spark, f"{folder}/rows").count(),
        "partitions": raw.rdd.getNumPartitions(),
        "columns": read_readings(spark, f"{folder}/rows").columns,
        "rejected": sorted(map(str, written.where("cleaning_outcome <> 'clean'").select("_malformed", "_datetime_text").distinct().collect())),
    }
    print("ANSWER" + json.dumps(answer))


if __name__ == "__main__":
    main(sys.argv[1])
