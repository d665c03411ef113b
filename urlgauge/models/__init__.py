"""Distributed learners: MLlib pipelines over URL features and character n-grams."""
