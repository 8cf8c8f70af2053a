"""Gridded-field compression analytics expressed as Spark DataFrame jobs."""
