import datetime as dt

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from affiche.settings import SETTINGS
from affiche.sources.settle import ensure_checkpoint_dir

AS_OF = dt.date(2026, 3, 1)


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("affiche-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "5000")
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture
def on_texts(spark):
    """Run a column function over texts, one result per text, in order."""

    def run(function, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "ix int, t string")
        out = rows.select("ix", function(F.col("t")).alias("r")).collect()
        by_ix = {r["ix"]: r["r"] for r in out}
        return [by_ix[i] for i in range(len(texts))]

    return run


@pytest.fixture
def plan_of():
    def plan(df) -> str:
        return df._jdf.queryExecution().executedPlan().toString()

    return plan
