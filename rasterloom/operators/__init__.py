"""Grid operators: each takes and returns DataFrames."""
