"""Quire: document analytics as Spark jobs."""
