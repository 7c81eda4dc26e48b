"""irloom: program-graph analytics as Spark DataFrames."""
