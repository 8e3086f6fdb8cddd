"""Operators of the re-ranking engine."""
