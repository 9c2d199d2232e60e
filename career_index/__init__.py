"""career_index: a Spark-native company / job-posting index built from crawled pages.

Subpackages
-----------
functions  Column expressions (URL canonicalisation, text keys, predicates, scores).
operators  DataFrame operators (extraction, dedupe, entity resolution, queries, health).
sources    Table loading, derived fixtures, snapshot read/write.
plans      User-level compositions (API queries, feed, enrichment, full index build).
streaming  Intentionally empty: the index is refreshed by a full batch rerun.
"""

__version__ = "0.1.0"
