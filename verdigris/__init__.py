"""Versioned feature tables and large-table data processing on Spark."""
