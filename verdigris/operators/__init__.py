"""DataFrame operators; each is a pure function from DataFrames to a DataFrame."""
