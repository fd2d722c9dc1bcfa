"""Operators for preparing training data: dedup, archives, packing, decontamination, extraction, scoring."""
