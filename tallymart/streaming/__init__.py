"""Structured Streaming jobs; each folds events as its batch counterpart does."""
