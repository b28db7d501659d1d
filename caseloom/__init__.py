"""Analytics over linked investigative records, as Spark DataFrames."""
