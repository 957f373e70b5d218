"""Scalar building blocks: analysis, markup, edit distance, length norms, highlighting."""
