"""Operators on text corpora for language models; nothing outside this subpackage imports it."""
