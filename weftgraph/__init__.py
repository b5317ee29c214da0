"""Spark-native graph pattern analytics: patterns are found and counted with DataFrame plans."""
