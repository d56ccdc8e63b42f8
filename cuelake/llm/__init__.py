"""Training-data operators: language ID, extraction, deduplication, mixing, packing."""
