"""Training-data operators: decontamination, tokenizers, quality, chat, dedup, language, HTML.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
