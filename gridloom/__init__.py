"""Multi-resolution grid analytics on PySpark DataFrames."""
