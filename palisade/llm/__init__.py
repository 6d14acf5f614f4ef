"""Training-data operators: filters, detectors, search, shards and packs for text corpora."""
