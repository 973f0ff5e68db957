import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from quakes.session import JVM_OPTIONS, apply_conf, checkpoint_dir

    s = (
        SparkSession.builder.master("local[*]")
        .appName("quakes-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.extraJavaOptions", JVM_OPTIONS)
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    apply_conf(s)
    checkpoint_dir(s)  # the session's folder; a local temp one only when unset
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="quakes-test-")
