"""Source-code quality analytics at corpus scale, on PySpark DataFrames."""
