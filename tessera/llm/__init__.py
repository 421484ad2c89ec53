"""Training-data operators: chat, search, packing, filters, dedup, tokens, media."""
