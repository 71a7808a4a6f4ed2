import datetime
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TEST_DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TXN = "t_dat date, customer_id string, article_id string, price double, sales_channel_id bigint"
CUST = "customer_id string, club_member_status string, fashion_news_frequency string, age bigint"
ART = "article_id string, product_type_name string, product_group_name string"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("stayrate-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def confs(spark):
    """Set session options for one test."""
    before = {}

    def set_all(**options):
        for key, value in options.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield set_all
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="session")
def make(spark):
    """Build frames of the three tables from short rows."""

    def day(text):
        return datetime.date.fromisoformat(text)

    class Make:
        @staticmethod
        def txn(rows):
            full = [(day(r[0]), r[1], *(tuple(r[2:]) + ("a", 1.0, 1)[len(r) - 2 :])) for r in rows]
            return spark.createDataFrame(full, TXN)

        @staticmethod
        def cust(rows):
            return spark.createDataFrame(rows, CUST)

        @staticmethod
        def art(rows):
            return spark.createDataFrame(rows, ART)

    return Make


@pytest.fixture(scope="session")
def tables(spark):
    from stayrate.sources import retail_tables

    return retail_tables(spark, TEST_DATA)


def plan_of(df) -> str:
    """The physical plan as ``explain`` prints it."""
    import contextlib
    import io

    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()
