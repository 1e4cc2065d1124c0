"""Training-data operators: quality, toxicity, language, dedup, decontamination, packing, token and WARC output.

Nothing else in the library imports this subpackage.
"""
