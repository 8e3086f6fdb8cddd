"""Streaming of the re-ranking engine."""
