"""Training-data operators: scoring, cleaning, formatting, tokenising, de-duplication, packing and sharding."""
