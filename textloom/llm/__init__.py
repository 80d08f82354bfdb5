"""Training-data operators (language-model scoring, mixing, quality, PII, WARC,
similarity join, nearest neighbours, token counts, packing, toxicity).

Nothing outside this subpackage imports it.
"""
