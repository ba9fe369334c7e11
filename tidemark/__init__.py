"""Sequence and annotation analytics as Spark DataFrame operators."""
