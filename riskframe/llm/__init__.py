"""Operators for large text corpora: cleaning, duplicates, contamination, scoring, counting, mixing and sharding.

Nothing outside this package imports it.  ``catalog`` registers one query per
operator; ``corpus_pipeline.py`` at the top of the repository chains five of them.
"""
