import os
import sys
import tempfile

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    shared = tempfile.mkdtemp(prefix="spark-")  # one machine: any folder is shared
    conf |= {"spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"{shared}/warehouse"}
    return SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
