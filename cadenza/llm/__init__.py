"""Operators for large training-text corpora (decontamination, quality rules,
HTML extraction, packing, token files, language ID, near and line duplicates,
toxicity, secrets).  ``registry`` holds the queries over the given tables."""
