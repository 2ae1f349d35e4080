"""Operators for preparing training text: cleaning, near-duplicates, decontamination, packing."""
