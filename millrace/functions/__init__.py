"""Scalar building blocks: keys, seeded draws and number text."""
