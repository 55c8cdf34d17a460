"""DataFrame operators: matching, deduplication, enrichment and aggregation."""
