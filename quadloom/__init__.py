"""quadloom: semantic-graph analytics on Spark DataFrames."""
