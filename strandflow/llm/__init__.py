"""Training-data operators over whole corpora: filters, tokens, near duplicates.

Nothing outside this subpackage imports it.
"""
