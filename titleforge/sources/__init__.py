"""Tables in and out: parquet, sessions as JSON, page results."""
