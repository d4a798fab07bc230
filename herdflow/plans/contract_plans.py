"""Data-quality contracts over other query outputs (J4, J5, J8), damaged in
places so that every check has something to find."""

from __future__ import annotations

from pyspark.sql import functions as F

from herdflow.operators.quality import domain_violations, null_sample_agreement, range_violations
from herdflow.operators.farm import reason_counts
from herdflow.plans.common import round_doubles
from herdflow.plans.farm_plans import CLASSIFY_REASONS_SQL, RECORD_RATIO_STATUS_SQL, classified, q_record_ratio_status
from herdflow.plans.lineage_plans import FARM_YEAR_MEAN_SQL, q_farm_year_mean
from herdflow.plans.registry import register
from herdflow.operators.joins import materialize, with_scalars

STATUS_COLUMNS = ["FARM_BIOSECURITY_STATUS", "FARM_HEALTH_STATUS", "FARM_ACCIDENT_STATUS"]
STATUS_DOMAIN = ["YES", "NO", "MISSING"]

CONTRACT_CHECKS_SQL = f"""
WITH rrs0 AS ({RECORD_RATIO_STATUS_SQL}),
rrs AS (SELECT CASE WHEN ends_with(farm, '3') THEN 'UNSURE' ELSE FARM_BIOSECURITY_STATUS END AS FARM_BIOSECURITY_STATUS,
  CASE WHEN ends_with(farm, '7') THEN lower(FARM_HEALTH_STATUS) ELSE FARM_HEALTH_STATUS END AS FARM_HEALTH_STATUS,
  CASE WHEN ends_with(farm, '1') THEN '' WHEN ends_with(farm, '2') THEN NULL ELSE FARM_ACCIDENT_STATUS END AS FARM_ACCIDENT_STATUS FROM rrs0),
cr0 AS ({CLASSIFY_REASONS_SQL}),
cr AS (SELECT CASE WHEN ends_with(farm, '4') THEN record_ratio + 1 ELSE record_ratio END AS record_ratio,
  CASE WHEN ends_with(farm, '5') THEN -total ELSE total END AS total FROM cr0),
fy0 AS ({FARM_YEAR_MEAN_SQL}),
fy AS (SELECT CASE WHEN FARM_YEAR_FATHER_SAMPLE_COUNT % 5 = 0 THEN NULL ELSE FARM_YEAR_FATHER_OFFSPRING_MEAN END AS FARM_YEAR_FATHER_OFFSPRING_MEAN,
  FARM_YEAR_FATHER_SAMPLE_COUNT, FARM_YEAR_MOTHER_OFFSPRING_MEAN,
  CASE WHEN FARM_YEAR_MOTHER_SAMPLE_COUNT % 7 = 0 THEN 0 ELSE FARM_YEAR_MOTHER_SAMPLE_COUNT END AS FARM_YEAR_MOTHER_SAMPLE_COUNT FROM fy0)
SELECT
  (SELECT CAST(count_if(FARM_BIOSECURITY_STATUS NOT IN ('YES', 'NO', 'MISSING')) AS BIGINT) FROM rrs) AS FARM_BIOSECURITY_STATUS_outside_domain,
  (SELECT CAST(count_if(FARM_HEALTH_STATUS NOT IN ('YES', 'NO', 'MISSING')) AS BIGINT) FROM rrs) AS FARM_HEALTH_STATUS_outside_domain,
  (SELECT CAST(count_if(FARM_ACCIDENT_STATUS NOT IN ('YES', 'NO', 'MISSING')) AS BIGINT) FROM rrs) AS FARM_ACCIDENT_STATUS_outside_domain,
  (SELECT CAST(count_if(record_ratio < 0 OR record_ratio > 1) AS BIGINT) FROM cr) AS record_ratio_out_of_range,
  (SELECT CAST(count_if(total < 0) AS BIGINT) FROM cr) AS total_out_of_range,
  (SELECT CAST(count_if((FARM_YEAR_FATHER_OFFSPRING_MEAN IS NULL AND FARM_YEAR_FATHER_SAMPLE_COUNT > 0)
      OR (FARM_YEAR_FATHER_OFFSPRING_MEAN IS NOT NULL AND FARM_YEAR_FATHER_SAMPLE_COUNT = 0)) AS BIGINT) FROM fy)
      AS FARM_YEAR_FATHER_OFFSPRING_MEAN_disagree,
  (SELECT CAST(count_if((FARM_YEAR_MOTHER_OFFSPRING_MEAN IS NULL AND FARM_YEAR_MOTHER_SAMPLE_COUNT > 0)
      OR (FARM_YEAR_MOTHER_OFFSPRING_MEAN IS NOT NULL AND FARM_YEAR_MOTHER_SAMPLE_COUNT = 0)) AS BIGINT) FROM fy)
      AS FARM_YEAR_MOTHER_OFFSPRING_MEAN_disagree
"""


@register("contract_checks", CONTRACT_CHECKS_SQL)
def q_contract_checks(spark, sf_dir):
    ends = lambda digit: F.col("farm").endswith(digit)
    records = materialize(classified(spark, sf_dir), "classified")      # both tables count these classes
    rrs = q_record_ratio_status(spark, sf_dir, records)
    rrs = rrs.withColumns({
        "FARM_BIOSECURITY_STATUS": F.when(ends("3"), F.lit("UNSURE")).otherwise(F.col("FARM_BIOSECURITY_STATUS")),
        "FARM_HEALTH_STATUS": F.when(ends("7"), F.lower("FARM_HEALTH_STATUS")).otherwise(F.col("FARM_HEALTH_STATUS")),
        "FARM_ACCIDENT_STATUS": F.when(ends("1"), F.lit("")).when(ends("2"), F.lit(None))
                                 .otherwise(F.col("FARM_ACCIDENT_STATUS"))})
    dom = domain_violations(rrs, {c: STATUS_DOMAIN for c in STATUS_COLUMNS})          # J4
    cr = round_doubles(reason_counts(records, farm="source", category="__cat"))
    cr = cr.withColumns({
        "record_ratio": F.when(ends("4"), F.col("record_ratio") + 1).otherwise(F.col("record_ratio")),
        "total": F.when(ends("5"), -F.col("total")).otherwise(F.col("total"))})
    rng = range_violations(cr, {"record_ratio": (0.0, 1.0), "total": (0, None)})     # J5
    fy = q_farm_year_mean(spark, sf_dir)
    fy = fy.withColumns({
        "FARM_YEAR_FATHER_OFFSPRING_MEAN": F.when(F.col("FARM_YEAR_FATHER_SAMPLE_COUNT") % 5 != 0,
                                                  F.col("FARM_YEAR_FATHER_OFFSPRING_MEAN")),
        "FARM_YEAR_MOTHER_SAMPLE_COUNT": F.when(F.col("FARM_YEAR_MOTHER_SAMPLE_COUNT") % 7 == 0, F.lit(0))
                                          .otherwise(F.col("FARM_YEAR_MOTHER_SAMPLE_COUNT"))})
    agree = null_sample_agreement(fy, {"FARM_YEAR_FATHER_OFFSPRING_MEAN": "FARM_YEAR_FATHER_SAMPLE_COUNT",
                                       "FARM_YEAR_MOTHER_OFFSPRING_MEAN": "FARM_YEAR_MOTHER_SAMPLE_COUNT"})  # J8
    out = with_scalars(dom, rng, agree)
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in out.columns])
