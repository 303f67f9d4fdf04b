"""Training-data operators: scoring, filtering, packing, deduplication and scans over document tables."""
