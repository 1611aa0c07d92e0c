"""tidemark: leak-free panel analytics on Spark DataFrames."""
