"""Training-data operators: toxicity, embedding near-dedup, BPE, binary token files,
HTML extraction, URL filters, line dedup, n-gram join, substring dedup, decontamination.

Nothing else in the library imports this package.
"""
