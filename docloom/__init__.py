"""docloom: document and retrieval analytics on Spark DataFrames."""
