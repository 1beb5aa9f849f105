"""Training-data operators: deduplication, search, quality, privacy, packing, archives, chat and extraction."""
