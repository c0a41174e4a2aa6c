"""Code-review analytics as PySpark DataFrame operators."""
