"""Operators over catalog tables."""
