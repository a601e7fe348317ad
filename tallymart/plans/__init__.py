"""Registered queries: operators applied to the given tables."""
