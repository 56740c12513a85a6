"""Training-data operators: chat formatting, extraction, tokens, decontamination,
near duplicates, language identification, quality and licence scans.

Nothing outside this subpackage imports it.  ``queries.py`` collects the
registered queries and their SQL.
"""
