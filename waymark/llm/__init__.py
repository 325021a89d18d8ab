"""Training-data operators: filtering, deduplication, packing, archives and classifiers."""
