"""Document-intelligence and compliance analytics on Spark DataFrames."""
