import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """The value of an expression over one row of literals."""
    from pyspark.sql import functions as F

    def value(make, *args):
        names = [f"c{i}" for i in range(len(args))]
        row = spark.range(1).select(*[F.lit(a).cast("string").alias(n) if a is None or isinstance(a, str) else F.lit(a).alias(n) for a, n in zip(args, names, strict=True)])
        return row.select(make(*names).alias("v")).first().v

    return value
