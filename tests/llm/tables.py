"""Small tables with every odd case: nulls, empties, ties, repeated rows, long texts, names that clash."""

from pyspark.sql import functions as F

#: Names that operators use for columns of their own; a user's columns of these names must come through unchanged.
CLASHING = (
    "row keep places weight gone high low text_hash n_words n_features score rank word near near_n cell block _salt"
).split()


def documents(spark, rows, clashing=()):
    """(doc_id, text) as documents, with further columns whose names clash with those of the operators."""
    docs = spark.createDataFrame(list(rows), "doc_id long, text string")
    return docs.select("*", F.lit("en").alias("lang"), *(F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in clashing))
