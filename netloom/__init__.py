"""netloom: network-flow and router-fleet analytics expressed as Spark DataFrames."""
