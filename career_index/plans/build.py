"""Index build: directory extraction -> union -> dedupe -> enrichment -> resolution (Q6-Q9)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from career_index.operators import dedupe as D
from career_index.operators import health as H
from career_index.operators.directory import build_directory
from career_index.operators.enrich import CrawlPolicy, enrich
from career_index.operators.ranking import with_rank
from career_index.operators.resolve import final_records, resolve_fold
from career_index.sources.snapshot import write_companies, write_health
from career_index.storage import stored


def resolve(*lists: DataFrame) -> DataFrame:
    """Q7: merge company lists (U2), gate (F2), order-dependent resolution (W8). ``ord`` becomes the rank in the merged order if there are several lists."""
    if len(lists) == 1:
        return resolve_fold(stored(final_records(lists[0]), "final-records"))
    merged = final_records(D.union_lists(*lists), keep=("list_rank", "ord")).withColumnRenamed("ord", "list_ord")
    return resolve_fold(with_rank(merged, "list_rank", "list_ord", rank_col="ord").drop("list_rank", "list_ord"))


def run_index(pages: DataFrame, seeds: DataFrame, directory_root: str, policy: CrawlPolicy | None = None,
              companies_path: str | None = None, health_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Q9: returns (companies, health) of a whole build, and writes them (S3, S4) where paths are given.

    Every stage is written, so that a lost executor recomputes one stage, not the whole lineage; the counts of the health record are those of the written stages."""
    raw = stored(D.union_sources(build_directory(pages, seeds, directory_root, policy)), "raw")
    deduped = stored(D.dedupe_candidates(raw), "deduped")
    enriched = stored(enrich(deduped, pages, policy), "enriched")
    companies = stored(resolve(enriched.withColumn("ord", D.candidate_order())), "companies")
    record = H.health(raw, deduped, enriched, companies)
    if companies_path:
        write_companies(companies, companies_path)
    if health_path:
        write_health(record, health_path)
    return companies, record
