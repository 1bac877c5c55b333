"""Training-data operators: tokenising, archives, quality, duplicates, personal data and packing."""
