"""Spark-native retrieval and analytics engine over structured and text tables."""
