"""Analytics for hierarchical, cross-citing document collections on Spark DataFrames."""
