"""Table access, derived input fixtures, crawl-snapshot fixtures and snapshot read/write."""
