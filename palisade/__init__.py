"""Sensitive-data detection and reversible tokenization on Spark."""
