"""Continuous routing and online statistics."""
