"""Multi-version change logs as DataFrames."""
