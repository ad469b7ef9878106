"""matchloom: record linkage on Spark DataFrames."""
