"""Evidence-graph and corpus processing on Spark DataFrames."""
