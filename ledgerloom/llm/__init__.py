"""Training-data operators: language, scoring, deduplication, quality, secrets, URLs, decontamination, shards, tokens."""
