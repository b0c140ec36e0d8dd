"""Training-data operators: deduplication, filters, tokens, packing, search, extraction."""
