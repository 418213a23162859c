"""Training-data operators (URL filter, PII, LM score, language ID, dedup, packing, decontamination, sharding).

Self-contained: it may import general helpers of the library, nothing in the library imports it.
"""
