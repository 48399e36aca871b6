"""Training-data operators: search, dedup, language, URL, decontamination, secrets, PII, chat and mixing.

Nothing else in the package imports this subpackage; it can be removed as a whole.
"""
