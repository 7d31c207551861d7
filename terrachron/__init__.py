"""Versioned map-element histories, replication feeds and vector tiles on PySpark."""
