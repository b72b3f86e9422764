"""Place-and-time risk analytics on Spark DataFrames."""
