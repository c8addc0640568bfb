"""Training-data operators: quality, packing, extraction, secrets, decontamination, URL rules,
near-duplicates, chat windows, language identification, token-count rollups, ranked search and filter audit.

Nothing outside this package imports it; ``queries.py`` holds its registered queries.
"""
