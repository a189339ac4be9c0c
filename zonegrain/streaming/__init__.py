"""Samples and results that arrive over time."""
