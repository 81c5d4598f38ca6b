"""Scalar functions: Column expressions, and Pandas UDFs where Spark has none."""
