"""tierwise: hierarchical entity analytics and corpus preparation on Spark DataFrames."""
