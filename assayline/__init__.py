"""assayline: longitudinal laboratory-result analytics on Spark DataFrames."""
