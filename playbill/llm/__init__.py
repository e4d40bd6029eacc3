"""Training-data operators: quality, deduplication, personal data, packing, decontamination, toxicity, language."""
