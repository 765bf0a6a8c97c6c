"""Equity fundamentals and price analytics expressed as Spark DataFrame plans."""
