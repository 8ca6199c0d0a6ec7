"""Millrace: data-engineering patterns as Spark-native operators."""
