"""Readers and writers of graph tables."""
