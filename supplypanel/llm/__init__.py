"""Training-data operators: cleaning, deduplication, tokenisation and packing of text corpora."""
