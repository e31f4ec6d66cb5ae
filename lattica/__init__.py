"""lattica: knowledge-graph retrieval analytics on Spark DataFrames."""
