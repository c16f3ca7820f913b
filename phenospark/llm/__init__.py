"""Operators over training text: deduplication, decontamination, packing, scoring. Nothing else in the library imports them."""
