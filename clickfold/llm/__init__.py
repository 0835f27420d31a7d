"""Training-data operators: language ID, line dedup, secret scan, embedding
and SimHash near-dedup, nearest neighbours, source mixing, BPE, WARC bundles
and chat formatting. Nothing outside this subpackage imports it."""
