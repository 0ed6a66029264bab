"""Training-data operators: quality, deduplication, privacy, packing, decontamination, language, URLs, LM scores.

Self-contained: nothing else in the library imports this subpackage, and it imports nothing from the rest.
"""
