import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    own = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{own}").config("spark.sql.warehouse.dir", f"{own}/warehouse")
        .config("spark.sql.ui.retainedExecutions", "5").config("spark.ui.retainedJobs", "20").config("spark.ui.retainedStages", "20").config("spark.ui.retainedTasks", "500").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True, scope="module")
def nothing_stays_cached(spark):
    yield
    spark.catalog.clearCache()
