"""Movement analytics on Spark DataFrames."""
