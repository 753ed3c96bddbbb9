"""Privacy and page analytics on Spark DataFrames."""
