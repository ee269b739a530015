"""Training-data operators: scoring, mixing, token output, filtering, deduplication, decontamination."""
