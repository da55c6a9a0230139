"""showerlake: event analytics on Spark DataFrames."""
