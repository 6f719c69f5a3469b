"""Queries over concrete tables."""
