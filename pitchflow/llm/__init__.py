"""Training-data operators: search, scoring, token counting, deduplication, packing, mixing."""
