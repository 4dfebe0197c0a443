"""Training-data operators: language ID, deduplication, decontamination, packing, scoring, search."""
