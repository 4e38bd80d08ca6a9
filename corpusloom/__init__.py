"""Mining and searching document collections with Spark DataFrames."""
