"""Customer and sales-force analytics as plain functions over Spark DataFrames."""
