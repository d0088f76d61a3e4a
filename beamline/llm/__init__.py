"""Training-data operators: deduplication, filtering, mixing and encoding of text."""
