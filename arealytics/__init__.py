"""Composite area indices, spatial joins and data-quality contracts as Spark DataFrame operators."""
