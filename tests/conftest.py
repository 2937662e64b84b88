import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lumenframe.session import session

    s = session("tests", spark_master="local[4]", spark_sql_shuffle_partitions=4, spark_ui_enabled="false", spark_driver_memory="4g", spark_ui_showConsoleProgress="false")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def plain(spark):
    """The session while it pushes no filters into Python sources, as Spark does by default."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


@pytest.fixture
def one(spark):
    """Value of one Column on one row."""

    def value(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    return value


@pytest.fixture
def refused():
    def check(f):
        with pytest.raises(Exception) as e:  # noqa: PT011
            f()
        assert "G" in str(e.value) or "refus" in str(e.value).lower()

    return check
