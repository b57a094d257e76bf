import os
import sys
import time

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(autouse=True)
def nothing_cached(request):
    """What a test caches is not there for the next one."""
    yield
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").catalog.clearCache()


@pytest.fixture
def shuffle_files(spark):
    """Names of shuffle files on disk; with those of before, new ones that are still there after a while."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def found(before=None):
        for _ in range(1 if before is None else 50):
            names = {
                name for root in manager.localDirs() for _, _, files in os.walk(str(root)) for name in files
                if name.startswith("shuffle_")
            }
            left = names - (before or set())
            if not left:
                break
            time.sleep(0.2)
        return left

    return found
