"""Equity analytics expressed as Spark DataFrame plans."""
