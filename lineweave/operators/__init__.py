"""Relational operators: script events, intervals, matching, windows and readings."""
