"""A PySpark document-audit engine."""
