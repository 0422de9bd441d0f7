"""Scalar, array, text and statistical functions as Spark columns."""
