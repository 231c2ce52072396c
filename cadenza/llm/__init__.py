"""Training-data operators: filtering, formatting, packing and deduplication of text corpora."""
