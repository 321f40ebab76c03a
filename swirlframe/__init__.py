"""swirlframe: analytics over space-time vector fields, on Spark DataFrames."""
