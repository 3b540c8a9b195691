"""Match-record analytics and corpus preparation on Spark DataFrames."""
