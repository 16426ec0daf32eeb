"""Point-cloud, frame-sequence and training-text analytics on Spark DataFrames."""
