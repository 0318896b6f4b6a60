"""Training-data operators: quality, toxicity, fingerprints, decontamination, token
shards, near-duplicates, WARC, packing, token counts and language identification.

Nothing outside this subpackage imports it.
"""
