import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from gleanery.cluster import ship

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.codegen.wholeStage", "false")  # tables of a few rows: compiling takes longer than running
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "file:///tmp/checkpoints/gleanery-tests")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return ship(session)
