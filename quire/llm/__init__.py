"""Training-data operators: deduplication, quality, search, sharding, packing, extraction, mixing, token counts."""
