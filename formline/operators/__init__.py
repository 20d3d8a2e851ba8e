"""DataFrame operators. Each takes and returns DataFrames; column names are arguments."""
