"""Readers, writers and source checks."""
