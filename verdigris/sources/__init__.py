"""Catalog, snapshot store and connectors."""
