"""Operators for large text corpora: near-duplicate search, licence, toxicity and secret scans, chat formatting,
language-model scoring, substring deduplication, quality rules, source mixing, benchmark decontamination, language
identification, filter audits and ranked lexical search.

Nothing outside this package imports it; ``queries`` lists its entries for the driver.
"""
