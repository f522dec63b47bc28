"""Training-data operators: quality, packing, decontamination, chat formatting,
toxicity, near-duplicates, WARC archives, line dedup and language id.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
