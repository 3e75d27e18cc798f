"""Multiresolution signal analytics as Spark DataFrame jobs."""
