"""Operators for preparing large training corpora, as Spark jobs."""
