"""Training-data operators: each module holds one operator on Spark DataFrames."""
