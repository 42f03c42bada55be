"""Scoring of submissions as they arrive."""
