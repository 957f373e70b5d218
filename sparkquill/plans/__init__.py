"""Queries: values, grammar, and their resolution against an index's dictionary."""
