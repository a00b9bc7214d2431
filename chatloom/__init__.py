"""Chat-retrieval analytics and corpus preparation on Spark DataFrames."""
