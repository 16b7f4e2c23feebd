"""Training-data operators: scoring, deduplication, packing, encoding and scans over document tables."""
