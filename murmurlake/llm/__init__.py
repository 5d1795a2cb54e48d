"""Training-data operators: deduplication, filtering, labelling and mixing of text corpora."""
