"""Queries of the text and record problems over a scale directory, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import leakage, linkage, markup, mojibake, packing, sentences, survivors, truncation, variants
from ledgerloom.session import read_table, spread


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_markup(spread(read_table(spark, sf_dir, "raw_text"))).where("n_constructs > 0").select("accession_number").distinct()


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_markup(spread(read_table(spark, sf_dir, "raw_text")))


def p1_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.site_templates(spread(read_table(spark, sf_dir, "raw_text")))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link(*(read_table(spark, sf_dir, t) for t in ("fortune", "eto_core", "eto_ticker", "eto_alias", "fundamentals")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).where("confidence >= 0.5").select("rank", "source", "entity_id").distinct()


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_ends(spread(read_table(spark, sf_dir, "sections")), "section_id", "text").distinct()


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(spread(read_table(spark, sf_dir, "sections")), "section_id", "text")


def _all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (("fortune", "company"), ("eto_core", "eto_name"), ("eto_alias", "alias"), ("fundamentals", "conm"))
    first, *rest = (read_table(spark, sf_dir, t).select(F.col(c).alias("name")) for t, c in tables)
    for r in rest:
        first = first.union(r)
    return first


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.name_pairs(variants.name_clusters(_all_names(spark, sf_dir)))


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.name_clusters(_all_names(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(spread(read_table(spark, sf_dir, "sections"))).where("cut").select("section_id").distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_report(spread(read_table(spark, sf_dir, "sections")))


def p6_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.deciding_levels(spread(read_table(spark, sf_dir, "sections")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = survivors.survivors(read_table(spark, sf_dir, "fundamentals"))
    return s.where("n_records > 1").select("gvkey", F.col("fyear").cast("int").alias("fyear"), "record_id")


def p7_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(read_table(spark, sf_dir, "fundamentals"))


def p7_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = survivors.truth(survivors.records(read_table(spark, sf_dir, "fundamentals")))
    return t.select("gvkey", F.col("fyear").cast("int").alias("fyear"), "field", "value", F.round("support", 4).alias("support"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(read_table(spark, sf_dir, "documents").select("doc_id", "n_tokens")))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_fill(packing.pack(spread(read_table(spark, sf_dir, "documents").select("doc_id", "n_tokens"))))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(spread(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaks(spread(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.max("n_words").alias("longest"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_documents(spread(read_table(spark, sf_dir, "documents"))).select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restore(spread(read_table(spark, sf_dir, "documents"))).where("is_garbled").select("doc_id", "restored_text", "n_unrestored")


QUERIES = {k: f for k, f in globals().items() if k[:1] == "p" and "_" in k and k[1].isdigit()}

SQL = {
    "p7_found": """
WITH r AS (
  SELECT DISTINCT lpad(regexp_replace(trim(gvkey), '\\.0+$', ''), 8, '0') AS gvkey, fyear, record_id, loaded_at,
    CASE WHEN isnan("at") THEN NULL ELSE "at" END AS assets,
    16 * (coalesce(upper(trim(indfmt)), '') = 'INDL')::INT + 8 * (coalesce(upper(trim(curcd)), '') = 'USD')::INT + 4 * (coalesce(upper(trim(datafmt)), '') = 'STD')::INT
      + 2 * (coalesce(upper(trim(consol)), '') = 'C')::INT + (emp IS NOT NULL AND NOT coalesce(isnan(emp), false))::INT AS score
  FROM fundamentals WHERE fyear IS NOT NULL
)
SELECT gvkey, fyear::INT AS fyear, record_id FROM (
  SELECT *, row_number() OVER (PARTITION BY gvkey, fyear ORDER BY score DESC, assets DESC NULLS LAST, loaded_at DESC, record_id) AS rn,
    min(record_id) OVER (PARTITION BY gvkey, fyear) AS lo, max(record_id) OVER (PARTITION BY gvkey, fyear) AS hi FROM r)
WHERE rn = 1 AND lo <> hi""",
}
