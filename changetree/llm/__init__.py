"""Training-data operators: deduplication, extraction, filtering, token counting and packing."""
