"""Feature-matrix queries: farm features aligned on one key, area contracts and
shares of channel values."""

from __future__ import annotations

from pyspark.sql import functions as F

from herdflow.functions.dates import parse_date
from herdflow.functions.nulls import sentinel_to_null, zero_to_sentinel
from herdflow.operators.farm import first_known
from herdflow.operators.quality import multi_valued_groups, value_shares
from herdflow.operators.rows import add_polynomial, aligned_join, select_numeric, zero_fill
from herdflow.operators.series import select_channels
from herdflow.plans.common import round_doubles
from herdflow.plans.registry import register
from herdflow.sources.tables import table

# --------------------------------------------------------------------------
# One row per farm: counts aligned with the farm table (D5), farms without
# records 0 (H4), sentinel balances missing (B4), a squared term (B40), dates in
# a fixed format (B7), the first known large order (E2), numeric columns only.

FARM_MATRIX_SQL = """
WITH n AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS n_open FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
d AS (SELECT o_custkey, min(strftime(o_orderdate, '%Y%m%d')) AS first_text FROM orders GROUP BY 1),
big AS (SELECT o_custkey, arg_min(big, o_orderkey) FILTER (big IS NOT NULL) AS first_big
        FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice > 200000 THEN floor(o_totalprice) END AS big FROM orders) GROUP BY 1)
SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN floor(c_acctbal) END AS balance,
  CAST(coalesce(n_open, 0) AS BIGINT) AS n_open, CAST(coalesce(n_open, 0) * coalesce(n_open, 0) AS DOUBLE) AS n_open_sq,
  CAST(CASE WHEN coalesce(n_open, 0) = 0 THEN -99 ELSE n_open END AS BIGINT) AS n_open_out,
  CASE WHEN c_custkey % 11 <> 0 THEN CAST(year(strptime(first_text, '%Y%m%d')) AS INTEGER) END AS first_year, first_big
FROM customer LEFT JOIN n ON c_custkey = n.o_custkey LEFT JOIN d ON c_custkey = d.o_custkey LEFT JOIN big ON c_custkey = big.o_custkey
"""


@register("farm_matrix", FARM_MATRIX_SQL)
def q_farm_matrix(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    c = c.withColumn("balance", F.when(F.col("c_custkey") % 7 == 0, F.lit(-99.0)).otherwise(
        F.floor("c_acctbal").cast("double"))).drop("c_acctbal")
    c = c.withColumn("balance", F.when(F.col("c_custkey") % 7 == 0, sentinel_to_null("balance")).otherwise(F.col("balance")))
    farm = F.col("o_custkey").alias("c_custkey")
    n = o.filter(F.col("o_orderkey") % 3 == 0).groupBy(farm).agg(F.count_if(F.col("o_orderstatus") == "P").alias("n_open"))
    d = o.groupBy(farm).agg(F.min(F.date_format("o_orderdate", "yyyyMMdd")).alias("first_text"))
    big = first_known(o.withColumn("big", F.when(F.col("o_totalprice") > 200000, F.floor("o_totalprice").cast("double"))),
                      key="o_custkey", value="big", order=["o_orderkey"], out="first_big")
    m = aligned_join(aligned_join(aligned_join(c, n, ["c_custkey"]), d, ["c_custkey"]),
                     big.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])
    m = add_polynomial(zero_fill(m, ["n_open"]), "n_open")
    text = F.when(F.col("c_custkey") % 11 == 0, F.lit("unknown")).otherwise(F.col("first_text"))
    m = m.withColumn("first_year", F.year(parse_date(text, "yyyyMMdd")))
    m = m.withColumn("n_open_out", zero_to_sentinel("n_open").cast("bigint"))
    return select_numeric(m)


# --------------------------------------------------------------------------
# Farms and groups with several area values (J6, J9), in damaged areas.

AREA_CONTRACTS_SQL = """
WITH a AS (SELECT c_custkey AS farm, c_mktsegment || ':' || c_nationkey AS grp,
             100 + c_nationkey + CASE WHEN c_custkey % 19 = 0 AND o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS area
           FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 23 <> 1),
f AS (SELECT farm AS name, count(DISTINCT area) AS n FROM a GROUP BY farm HAVING count(DISTINCT area) > 1),
g AS (SELECT grp AS name, count(DISTINCT area) AS n FROM a GROUP BY grp HAVING count(DISTINCT area) > 1)
SELECT 'farm' AS level, CAST(name AS VARCHAR) AS name, CAST(n AS BIGINT) AS n_values FROM f
UNION ALL SELECT 'group', name, CAST(n AS BIGINT) FROM g
"""


@register("area_contracts", AREA_CONTRACTS_SQL)
def q_area_contracts(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment").filter(F.col("c_custkey") % 23 != 1)
    twice = (F.col("c_custkey") % 19 == 0) & (F.col("o_orderkey") % 2 == 0)
    a = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_custkey").cast("string").alias("farm"),
        F.concat_ws(":", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("grp"),
        (F.lit(100) + F.col("c_nationkey") + twice.cast("int")).alias("area"))
    farms = multi_valued_groups(a, "farm", "area").select(F.lit("farm").alias("level"), F.col("farm").alias("name"), "n_values")
    groups = multi_valued_groups(a, "grp", "area").select(F.lit("group").alias("level"), F.col("grp").alias("name"), "n_values")
    return farms.unionByName(groups)


# --------------------------------------------------------------------------
# Shares of values (J15) of one channel and of all.

CHANNEL_SHARES_SQL = """
WITH e AS (SELECT event_type, CASE WHEN value >= 1 THEN CAST(floor(value / 25) AS INTEGER) END AS level FROM events),
m AS (SELECT 'M' AS features, level, count(*) AS n FROM e GROUP BY level),
s AS (SELECT 'S' AS features, level, count(*) AS n FROM e WHERE event_type = 'click' GROUP BY level)
SELECT features, level, CAST(n AS BIGINT) AS n, round(n / (SELECT sum(n) FROM m), 6) AS share FROM m
UNION ALL SELECT features, level, CAST(n AS BIGINT), round(n / (SELECT sum(n) FROM s), 6) FROM s
"""


@register("channel_shares", CHANNEL_SHARES_SQL)
def q_channel_shares(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_type", "value").select(
        "event_type", F.when(F.col("value") >= 1, F.floor(F.col("value") / 25).cast("int")).alias("level"))
    parts = [value_shares(select_channels(e, f, "click", "event_type"), "level").select(F.lit(f).alias("features"), "*")
             for f in ("M", "S")]
    return round_doubles(parts[0].unionByName(parts[1]))
