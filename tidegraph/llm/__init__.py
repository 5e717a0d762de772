"""Training-data operators: token output, extraction, archives, dedup, media, secrets, language, toxicity, leaks, packing."""
