"""Document-tree analytics on Spark DataFrames."""
