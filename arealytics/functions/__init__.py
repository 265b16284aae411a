"""Column functions: each takes and returns Spark Columns, with no shuffle and no Python UDF."""
