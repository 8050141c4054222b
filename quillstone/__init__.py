"""Record review and preparation on Spark DataFrames."""
