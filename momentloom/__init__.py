"""momentloom: timed-media analytics on PySpark DataFrames."""
