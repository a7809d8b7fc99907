"""Readers, writers and reference data files."""
