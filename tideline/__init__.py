"""Daily-panel analytics on Spark DataFrames."""
