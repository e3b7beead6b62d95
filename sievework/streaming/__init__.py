"""Drift over a stream."""
