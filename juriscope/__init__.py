"""Citation-graph analytics over court opinions, expressed as Spark DataFrames."""
