"""Index build and upkeep, scoring, search and highlighting as DataFrame operators."""
