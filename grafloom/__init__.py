"""Analytics over graphs of source structure, on Spark DataFrames."""
