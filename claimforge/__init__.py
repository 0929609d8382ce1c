"""Governed-claims analytics as declarative Spark plans."""
