"""Training-data operators: mixing, extraction, similarity joins, token files, dedup, fingerprints, BPE, language and quality models, sharding."""
