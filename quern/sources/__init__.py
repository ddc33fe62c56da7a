"""Readers, writers and the mapping of plain tables to the retrieval model."""
