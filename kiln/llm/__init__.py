"""Training-data operators: language ID, exact search, URL rules,
deduplication, packing, classifiers and sampled segmentation."""
