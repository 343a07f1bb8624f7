"""Session settings the jobs are written for. All are ordinary Spark settings; none changes a result."""

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot does not compile methods beyond 8,000 bytes: long rule chains run twice as fast in pieces.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Pages are large rows: keep the Arrow batches handed to Python small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.session.timeZone": "UTC",
}
