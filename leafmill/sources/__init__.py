"""Capture readers and saved result tables."""
