"""tagsmith: retail price analytics as plain Spark DataFrame functions."""
