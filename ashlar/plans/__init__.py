"""Logical plans: the named queries built from the operators."""
