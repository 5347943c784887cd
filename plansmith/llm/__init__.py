"""Training-data operators: token files, line dedup, packing, sharding, LM scoring, BPE,
tokeniser quality rules, exact vector search, licence scans and the n-gram Jaccard join."""
