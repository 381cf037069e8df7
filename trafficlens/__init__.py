"""Network-traffic and flood analytics as Spark DataFrames and streams."""
