"""Training-data operators: sanitising, deduplication, filtering, formatting, packing and sharding of text corpora."""
