"""Retail sales analytics as Spark DataFrame jobs over a star schema."""
