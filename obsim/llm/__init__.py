"""Training-data operators: sharding, deduplication, quality, scans, decontamination and mixing."""
