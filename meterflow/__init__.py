"""Meter and sensor time-series analytics as plain PySpark DataFrame operators."""
