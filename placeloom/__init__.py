"""Spark-native operators for building and auditing registers of places."""
