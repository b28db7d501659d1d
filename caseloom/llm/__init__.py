"""Training-data operators: scans, near-duplicate search, packing, archives and filters."""
