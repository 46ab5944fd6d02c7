"""Readers of documents, catalogs, line records and artifacts."""
