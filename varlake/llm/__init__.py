"""Training-data operators: scoring, archives, filters, search, packing, dedup, quality, language."""
