"""Spark-native accountability analytics over public-spending style records."""

__version__ = "0.1.0"
