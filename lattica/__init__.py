"""Lattica: network, enrichment, matrix and text analytics as PySpark DataFrame operators."""
