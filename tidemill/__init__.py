"""Tidemill: a PySpark-native event-time feature engine."""
