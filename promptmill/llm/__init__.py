"""Operators for preparing training text: filters, archives, token files, search, de-duplication."""
