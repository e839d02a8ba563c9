"""Millrace: seeded retail data, data-quality checks and bronze publishing as Spark plans."""
