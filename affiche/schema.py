"""Schemas of the activity table and its reads."""

from pyspark.sql import types as T

ACTIVITY_FIELDS = [
    T.StructField("title", T.StringType(), False),
    T.StructField("summary", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("category", T.StringType(), False),
    T.StructField("age_min", T.IntegerType()),
    T.StructField("age_max", T.IntegerType()),
    T.StructField("event_date", T.StringType()),  # yyyy-MM-dd text, not checked against the calendar
    T.StructField("event_time", T.StringType()),  # HH:mm text
    T.StructField("price", T.StringType()),
    T.StructField("city", T.StringType(), False),
    T.StructField("source_url", T.StringType(), False),
]
NEW_ACTIVITY = T.StructType(ACTIVITY_FIELDS)
ACTIVITY = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        *ACTIVITY_FIELDS,
        T.StructField("created_at", T.TimestampType()),
    ]
)
REQUIRED = [f.name for f in ACTIVITY_FIELDS if not f.nullable]
# A stored row is the same as a new one when these agree and the date is known.
KEY = ["title", "event_date", "city", "source_url"]
# What a read returns: everything but the load time.
READ_COLUMNS = ["id", *NEW_ACTIVITY.names]
