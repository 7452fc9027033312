"""Grouped queries: measures per dimension, single visuals and whole sheets."""
