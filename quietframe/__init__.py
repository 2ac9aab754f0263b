"""quietframe: differentially private analytics and data preparation on Spark DataFrames."""
