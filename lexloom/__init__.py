"""lexloom: lexical analytics on Spark DataFrames."""
