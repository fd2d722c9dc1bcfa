"""DataFrame operators: joins, metrics, alignment, codebooks, splits, resampling, ledgers."""
