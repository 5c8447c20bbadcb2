"""Operators of a training-data pipeline (chat formatting, near-duplicate and
substring removal, language identification, secret scans, URL filters, line
templates, tokenisation, benchmark decontamination).

Nothing else in the library imports this package; its queries are registered
by ``queries.py``."""
