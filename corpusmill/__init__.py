"""Corpus analytics on Spark: sources, tokenisation, windows, scoring, statistics, packing."""
