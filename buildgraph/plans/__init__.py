"""Query registry: sample-table mappings, queries and their SQL oracles."""
