"""Training-data operators: filtering, deduplication, decontamination, mixing and formatting of text corpora.

Nothing else in the library imports this subpackage.
"""
