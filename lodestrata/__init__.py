"""Density hierarchies of point data, as DataFrame and SQL operators for Spark."""
