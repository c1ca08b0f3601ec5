"""Training-data operators: sharding, toxicity, packing, PII, secrets, media, near-duplicates, HTML, BPE, exact search."""
