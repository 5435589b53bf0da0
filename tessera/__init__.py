"""Spark-native search and analytics over message and document archives."""
