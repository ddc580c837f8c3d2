"""Case analytics on Spark DataFrames."""
