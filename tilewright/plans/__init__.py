"""Cube expressions as trees that run as one Arrow function each."""
