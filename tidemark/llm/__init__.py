"""Training-data operators: archives, packing, classifiers, deduplication, mixing."""
