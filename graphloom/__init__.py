"""graphloom: code-graph analytics and corpus operators on Spark DataFrames."""
