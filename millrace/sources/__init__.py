"""Readers and seeded generators."""
