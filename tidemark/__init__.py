"""Spark-native table replication, reconciliation and reporting."""
