"""Document redaction analytics and training-data operators on Spark DataFrames."""
