"""Training-data operators: archives, dedup, extraction, filtering, tokens, packing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
