"""Queries of problem 2 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators.indicator_fill import fill_indicators, filled_cells
from ledgerloom.session import read_table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_cells(fill_indicators(read_table(spark, sf_dir, "indicators"))).select("record_id", "field").distinct()


def p2_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_cells(fill_indicators(read_table(spark, sf_dir, "indicators"))).distinct()


QUERIES = {"p2_found": p2_found, "p2_filled": p2_filled}

_named = "(lower(coalesce({0}, '')) LIKE '%unmatched%' OR lower(coalesce({0}, '')) LIKE '%zero_denominator%')"
_lost = "SELECT DISTINCT record_id, '{0}_share' AS field FROM indicators WHERE NOT coalesce({0}_share BETWEEN 0 AND 2 AND NOT isnan({0}_share), false) AND NOT {1}"
SQL = {
    "p2_found": " UNION ALL ".join(_lost.format(x, _named.format(f"{x}_share_reason")) for x in ("ai_publication", "ai_worker"))
    + f" UNION ALL SELECT DISTINCT record_id, 'ai_patent_share_reason' AS field FROM indicators WHERE ai_patent_share IS NULL AND NOT {_named.format('ai_patent_share_reason')}"
}
