"""Training-data pipeline operators: token counts, exact top-k search, toxicity, n-gram Jaccard join,
packing, source mixing, fingerprints, repeated-passage removal, binary token output, licence scans, ranked lexical search,
SimHash near-duplicates, cross-tokenizer alignment.

Nothing else in the library imports this subpackage; ``queries`` registers one query per operator.
"""
