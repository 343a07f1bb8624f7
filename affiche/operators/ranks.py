"""Pages far down a long list without counting to them: rows kept in reading order, with the rank of each file.

``rank_rows`` writes the rows once in the order of reading, cut into files by ranges, and beside them one row for each
file: its first rank and how many rows it has. A page opens only the files it lies in, at every depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affiche.operators.filters import PER_PAGE
from affiche.operators.paging import ORDER

DIRECTORY = "file string, first_rank long, n long"


def rank_rows(df: DataFrame, path: str, files: int | None = None) -> None:
    """Write rows with the columns of ``ORDER`` in that order under ``path``, in about as many ``files`` (Spark's choice if not given).

    The ranges end in the id, so many rows of one date are split. Only the directory, one row a file, is
    ever brought together in one task.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(files, *ORDER) if files else df.repartitionByRange(*ORDER)
    ranged.sortWithinPartitions(*ORDER).write.mode("overwrite").parquet(f"{path}/rows")
    stored = spark.read.schema(df.schema).parquet(f"{path}/rows")
    first = F.min(F.struct(*ORDER)).alias("first")
    each = stored.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.count("*").alias("n"), first)
    before = W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    ranks = each.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"), "n")
    ranks.coalesce(1).write.mode("overwrite").parquet(f"{path}/directory")


def ranked_total(spark: SparkSession, path: str) -> int:
    """How many rows there are; no row is read."""
    return spark.read.schema(DIRECTORY).parquet(f"{path}/directory").agg(F.sum("n")).first()[0] or 0


def ranked_page(spark: SparkSession, path: str, page: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """Rows (page-1)*per_page .. page*per_page in reading order; none past the end.

    The files of the page are looked up in the directory; a page no longer than a file lies in two at most.
    """
    low, high = (page - 1) * per_page, page * per_page
    directory = spark.read.schema(DIRECTORY).parquet(f"{path}/directory")
    held = directory.filter((F.col("first_rank") < high) & (F.col("first_rank") + F.col("n") > low)).orderBy("first_rank").collect()
    if not held:
        return spark.read.parquet(f"{path}/rows").limit(0)
    rows = spark.read.parquet(*[f"{path}/rows/{r['file']}" for r in held])
    return rows.orderBy(*ORDER).offset(low - held[0]["first_rank"]).limit(per_page)
