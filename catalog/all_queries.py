"""Imports every query module, so that the registry is complete."""

from . import (  # noqa: F401
    alignment,
    codebooks,
    evaluations,
    labeling,
    ledgers,
    sheets,
    splits,
    texts,
)
