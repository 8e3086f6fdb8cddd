"""Sources of the re-ranking engine."""
