"""Readers and writers of the external formats."""
