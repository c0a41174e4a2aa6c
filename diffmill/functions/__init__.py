"""Column functions: they take and return Columns and run in the JVM."""
