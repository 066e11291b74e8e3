import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    # what makes many small jobs quick: few partitions, plans that aren't compiled or planned anew between stages
    options = {
        "spark.sql.shuffle.partitions": "2",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": "2",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    }
    builder = SparkSession.builder.master("local[4]").appName("wayloom-tests")
    for name, value in options.items():
        builder = builder.config(name, value)
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
