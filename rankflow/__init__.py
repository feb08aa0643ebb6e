"""Rankflow: contest analytics expressed as Spark DataFrame jobs."""
