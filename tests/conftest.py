import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logsieve.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark__ui__showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def make_log(spark):
    """A canonical log from (case, activity, resource, second) rows; event keys count up."""
    from pyspark.sql import functions as F

    from logsieve.sources.spec import EventLogSpec, to_canonical

    def make(rows, resource=True):
        data = [(f"{i:04d}", c, a, r, float(s)) for i, (c, a, r, s) in enumerate(rows)]
        df = spark.createDataFrame(data, "key string, c string, a string, r string, s double")
        us = F.floor(F.col("s") * 1e6).cast("bigint")
        df = df.withColumn("t", F.timestamp_add("MICROSECOND", us, F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")))
        return to_canonical(df, EventLogSpec("c", "a", "t", "r" if resource else None, "key"))

    return make
