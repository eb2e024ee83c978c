"""Approximate-membership filters on Spark."""
