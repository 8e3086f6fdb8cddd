"""Plans of the re-ranking engine."""
