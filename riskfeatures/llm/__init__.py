"""Training-data operators: dedup, quality, mixing, tokenisation, extraction,
formatting, scoring and secret scans.  Nothing else in the library imports this
subpackage; its queries are registered in ``queries``."""
