"""Queries over the given tables, and SQL that states what each must return."""
