"""waymark: trail-network analytics on Spark DataFrames."""
