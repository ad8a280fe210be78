"""Spark-native regional analytics: layers, allocation, matching, scoring, audits."""
