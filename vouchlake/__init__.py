"""Spark-first document-to-record analytics: extraction, reconciliation, reporting and training-data operators."""
