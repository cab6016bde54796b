"""Document retrieval on Spark: ingest, index, search."""
