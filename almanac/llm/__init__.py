"""Training-data operators: token files, packing, mixing, dedup, quality, chat, secrets."""
