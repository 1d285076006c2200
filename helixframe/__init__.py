"""Sequence, interval and graph analytics as PySpark DataFrame operators."""
