"""Analytics over collections of scholarly papers, expressed as Spark DataFrames."""
