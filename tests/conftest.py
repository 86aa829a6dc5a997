import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from rankscope.session import session_defaults

    b = SparkSession.builder.master("local[4]").appName("rankscope-tests")
    for k, v in session_defaults().items():
        b = b.config(k, v)
    s = b.config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "8g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rankscope-test-ckpt-"))
    yield s
    s.stop()
