"""Ordered subtitle text and evidence reports."""
