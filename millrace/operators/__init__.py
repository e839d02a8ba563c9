"""Defect injection and quality checks on any DataFrame."""
