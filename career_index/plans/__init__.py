"""User-level compositions: API queries (Q1-Q4), browser feed (Q5), enrichment (Q6),
resolution (Q7), directory build (Q8) and the full index run (Q9)."""
