"""Readers, writers, schemas and data contracts."""
