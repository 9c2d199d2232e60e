"""Record completeness and pairwise preference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _known(c: Column) -> Column:
    return (c != "") & (F.lower(c) != "unknown")


def completeness(name, website, career, country, source, jobs) -> Column:
    """Name 2, website 2, career page 3, known country 1, known source 1, has jobs 1."""
    def nz(c):
        return F.when(c != "", 1).otherwise(0)
    return (2 * nz(name) + 2 * nz(website) + 3 * nz(career)
            + F.when(_known(country), 1).otherwise(0) + F.when(_known(source), 1).otherwise(0)
            + F.when(F.size(F.coalesce(jobs, F.array())) > 0, 1).otherwise(0))


def right_wins(left_score, left_country, left_career, right_score, right_country, right_career) -> Column:
    """The newcomer replaces the kept record if it scores higher, or the kept record's
    country is unknown and the newcomer's is not, or the newcomer's career URL is shorter.
    Tie-breakers apply even when the newcomer scores lower (the relation is not an order)."""
    return ((right_score > left_score)
            | ((F.lower(left_country) == "unknown") & (F.lower(right_country) != "unknown"))
            | (F.length(right_career) < F.length(left_career)))
