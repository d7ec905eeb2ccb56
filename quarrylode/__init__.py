"""Company-data analytics and training-data preparation on Spark DataFrames."""
