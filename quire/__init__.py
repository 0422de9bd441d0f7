"""Corpus analytics as lazy Spark DataFrame queries."""
