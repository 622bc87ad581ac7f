"""Training-data operators: language ID, quality, WARC, packing, decontamination,
licence and secret scans, exact near-duplicate joins and language-model scoring.

Nothing outside this package imports it; ``webloom.llm.queries`` lists its queries.
"""
