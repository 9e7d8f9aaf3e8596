"""tidebook: asset-market analytics on Spark DataFrames."""
