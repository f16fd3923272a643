"""Training-data operators: mixing, deduplication, decontamination, scoring, token output."""
