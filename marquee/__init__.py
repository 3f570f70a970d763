"""Listing integration and discovery as Spark DataFrame operators."""
