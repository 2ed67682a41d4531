"""Training-data operators: mixing, scoring, tokens, near-duplicates, search and quality."""
