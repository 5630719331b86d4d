"""Training-data operators: packing, near-duplicates, language, quality, archives, search, rules, secrets, mixing, token files.

Nothing outside this folder, corpus_pipeline.py and their tests imports it.
"""
