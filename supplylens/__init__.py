"""Material consumption, stock and delivery analytics on Spark DataFrames."""
