"""Spark-native analytics over entity x quarter panels."""
