"""Set-wise operators: each takes and returns DataFrames."""
