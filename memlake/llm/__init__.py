"""Training-data operators: deduplication, decontamination, scans, scoring and packing."""
