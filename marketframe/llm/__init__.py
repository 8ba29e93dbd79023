"""Training-data operators: language ID, deduplication, mixing, packing, search and formatting."""
