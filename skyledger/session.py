"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .sources.paths import qualified_path, remove_at_end

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs the next aggregate a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows of long texts that a Python worker and its executor hold at once.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # The JVM leaves methods beyond 8,000 bytes to its interpreter. A stage with such a method runs by
    # operators instead, whose code Spark splits.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # What an action shuffled goes when it ends, not when the driver's heap happens to be collected. A
    # frame that runs a second time by the same reference makes its shuffles anew.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings every plan here relies on.

    They stay set: plans are built lazily, so they must hold when the caller runs them.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def drop_shuffles(persisted: DataFrame) -> None:
    """Remove the shuffle files behind a persisted frame all of whose blocks are there.

    They are no part of any one action, so they would stay until the driver's heap is collected. Where a
    block is lost later, Spark runs the stages behind it again.
    """
    context = persisted.sparkSession.sparkContext._jsc.sc()
    plan = persisted._jdf.queryExecution().withCachedData().cacheBuilder().cachedPlan()
    if plan.getClass().getSimpleName() != "AdaptiveSparkPlanExec":
        return
    for shuffle in list(plan.context().shuffleIds().keySet()):
        context.shuffleDriverComponents().removeShuffle(shuffle, True)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may do without: there every task runs on one machine, and a folder of the
    default file system serves.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return qualified_path(spark, "/tmp")


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder name under the shared folder; it is removed when the application ends."""
    own = f"{scratch_root(spark)}/skyledger/{spark.sparkContext.applicationId}"
    remove_at_end(spark, own)
    return f"{own}/{purpose}-{uuid.uuid4().hex}"
