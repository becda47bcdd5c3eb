"""Longitudinal supply-panel analytics as plain Spark DataFrame functions."""
