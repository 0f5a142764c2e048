"""Reduction, reconstruction and comparison of ordered series, as Spark jobs."""
