"""Timed-media and text analytics expressed as Spark DataFrame transformations."""
