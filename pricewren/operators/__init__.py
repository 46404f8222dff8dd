"""DataFrame operators: top-k, dedup, merge, SCD-2, data quality, fuzzy joins, full-text search, linkage."""
