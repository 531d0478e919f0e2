"""Training-data operators: scoring, fingerprints, joins, deduplication, packing, search."""
