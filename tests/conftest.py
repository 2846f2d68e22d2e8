import os
import sys
import tempfile

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from pairfield import ship

    local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {
        "spark.master": "local[4]", "spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false", "spark.local.dir": local, "spark.checkpoint.dir": f"file://{local}/shared",
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
