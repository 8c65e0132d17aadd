"""Sorted key-value tables on Spark."""
