"""Readers, writers and file catalogs."""
