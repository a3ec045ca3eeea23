"""fluvial: terrain and river analytics on PySpark DataFrames."""
