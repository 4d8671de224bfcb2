"""Whole flows composed of operators: processing states and reports."""
