"""Record projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from career_index.functions.text import ustrip
from career_index.functions.urls import normalize_url


def company_record(df: DataFrame, source: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Standard candidate projection: strip name and country, P1 on both URLs, attach source."""
    def s(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(*keep, ustrip(s("name")).alias("name"), normalize_url(s("website")).alias("website"),
                     normalize_url(s("career_page_url")).alias("career_page_url"),
                     ustrip(s("country_of_origin")).alias("country_of_origin"), F.lit(source).alias("source"))
