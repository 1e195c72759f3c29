"""Training-data operators: extraction, formatting, deduplication, scoring, packing."""
