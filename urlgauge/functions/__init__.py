"""Column-level functions: everything here stays a native Spark expression."""
