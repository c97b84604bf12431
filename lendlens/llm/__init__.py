"""Operators for preparing training text: extraction, filtering, deduplication,
decontamination and tokenisation. Nothing else in the library imports this
subpackage."""
