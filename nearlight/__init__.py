"""nearlight: vector similarity analytics on Spark DataFrames."""
