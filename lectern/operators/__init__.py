"""Reports and audits: DataFrames in, DataFrames out."""
