"""Training-data operators: sharding, chat rendering, decontamination, secret scans, near duplicates,
quality models, packing, token counts, substring removal, quality rules, fill-in-the-middle rewriting, packing in tiers and
importance resampling.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
