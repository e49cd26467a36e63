"""Training-data operators: identification, deduplication, mixing, packing and scoring of texts."""
