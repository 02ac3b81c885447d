"""Operators over program and dataset tables."""
