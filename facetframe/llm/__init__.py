"""Training-data pipeline operators (tokens, duplicates, language, quality, mixing, packing)."""
