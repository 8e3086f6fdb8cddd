"""Spark-native re-ranking engine for cross-modal retrieval, with evaluation, statistics and text sanitising."""
