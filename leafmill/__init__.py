"""Analytics for structured documents and the operational data around them, on Spark DataFrames."""
