"""Session-history analytics on Spark DataFrames."""
