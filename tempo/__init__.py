"""Tempo: event-time panel analytics and signal timing on PySpark."""
