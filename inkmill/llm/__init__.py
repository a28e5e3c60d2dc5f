"""Training-data operators: tokenising, sharding, packing, filtering, dedup."""
