"""Edges that keep arriving."""
