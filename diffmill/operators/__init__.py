"""Table operators: they take and return DataFrames and never collect rows."""
