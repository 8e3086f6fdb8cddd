"""Functions of the re-ranking engine."""
