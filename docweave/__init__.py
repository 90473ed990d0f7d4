"""Document analytics on Spark: ETL, catalogue queries, vector search, statistics and streams."""
