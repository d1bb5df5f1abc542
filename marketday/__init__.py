"""Layered retail-sales analytics and governance jobs as PySpark DataFrame programs."""
