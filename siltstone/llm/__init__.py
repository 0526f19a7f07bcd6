"""Corpus preparation operators: sharding, cleaning, deduplication, tokenised output and packing."""
