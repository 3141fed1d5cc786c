"""bytequarry: byte-sequence and compressibility analytics on PySpark DataFrames."""
