"""Column -> Column functions. None of them uses a Python UDF."""
