"""Structured Streaming counterparts of the runtime queries."""
