"""Readers, writers and table changes (insert, update, delete, upsert)."""
