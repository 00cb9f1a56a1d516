"""Capture-and-memory analytics expressed as Spark DataFrame plans."""
