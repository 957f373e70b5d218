"""Training-data operators: deduplication, filters, mixing, token and media output."""
