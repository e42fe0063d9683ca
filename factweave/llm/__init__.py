"""Training-data operators: dedup, mixing, tokenising, language and quality models."""
