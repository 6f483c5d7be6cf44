"""Field-of-view analytics and corpus preparation on Spark DataFrames."""
