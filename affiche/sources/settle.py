"""Cut a plan by writing its rows to the folder the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; only a local session may get a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        shared = tempfile.mkdtemp(prefix="affiche-checkpoint-")
    context.setCheckpointDir(shared)


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, worked out once and kept where a lost executor cannot take them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder.

    Unlike a checkpoint it has a size that Spark knows when it plans, so a small one is broadcast by
    Spark's own check and a large one is not. Rows come back in no fixed order.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
