"""Table operators: retrieval, lookups, attempts, reports and threshold curves."""
