"""URL-risk analytics on Spark: clean, split, describe, model and stress-test URL tables."""
