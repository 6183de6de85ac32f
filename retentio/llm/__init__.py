"""Training-data operators: token counts, fingerprints, dedup, quality, PII, sharding, packing, chat."""
