"""Page algebra and training-data operators on Spark DataFrames."""
