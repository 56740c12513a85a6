"""A PySpark engine for the structure of source code: symbols, calls, ranks."""
