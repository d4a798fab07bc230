"""Contracts, set operations, source union and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from herdflow.functions import nulls as N
from herdflow.functions.text import coalesce_preferred, prefix_id, split_address
from herdflow.operators.lineage import target_years
from herdflow.operators import quality
from herdflow.operators.quality import key_violations, row_preservation
from herdflow.plans.common import round_doubles
from herdflow.plans.lineage_plans import OFFSPRING_SQL, _offspring
from herdflow.plans.registry import register
from herdflow.sources.tables import table
from herdflow.operators.joins import materialize, with_scalars

# --------------------------------------------------------------------------
# Row contract: orders enriched with customer attributes.

ROW_CONTRACT_SQL = f"""
WITH j AS (SELECT o.*, c.c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
off AS ({OFFSPRING_SQL.replace("WITH ch AS", "WITH ch0 AS").replace("FROM ch ", "FROM ch0 ")}),
cd AS (SELECT CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_custkey END AS c_custkey FROM customer
       UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 50 = 0),
bad AS (SELECT * REPLACE (CASE WHEN TARGET_YEAR % 5 = 2 THEN PAST_OFFSPRING_COUNT - 1 ELSE PAST_OFFSPRING_COUNT END AS PAST_OFFSPRING_COUNT) FROM off),
mono AS (SELECT PAST_OFFSPRING_COUNT - lag(PAST_OFFSPRING_COUNT) OVER (PARTITION BY LINEAGE_NO, ROLE ORDER BY TARGET_YEAR) AS d FROM bad)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM orders) AS rows_before,
  (SELECT CAST(count(*) AS BIGINT) FROM j) AS rows_after,
  (SELECT CAST(count_if(c_custkey IS NULL) AS BIGINT) FROM cd) AS null_key_rows,
  (SELECT CAST(count(*) AS BIGINT) FROM (SELECT c_custkey FROM cd GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys,
  (SELECT CAST(count_if(o_orderkey % 103 = 0 AND o_orderkey <> 0) AS BIGINT) FROM orders) AS missing_rows,
  (SELECT CAST(count_if(o_orderkey % 107 = 0 AND o_orderkey <> 0) AS BIGINT) FROM orders) AS extra_rows,
  (SELECT CAST(count_if(o_orderkey % 101 = 0 AND o_orderkey % 103 <> 0) AS BIGINT) FROM orders) AS changed_rows,
  (SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) FROM orders) AS distinct_customers,
  (SELECT CAST(count_if(d < 0) AS BIGINT) FROM mono) AS decreasing_steps,
  (SELECT CAST(count_if(TARGET_YEAR = (SELECT min(TARGET_YEAR) FROM bad) AND PAST_OFFSPRING_COUNT <> 0) AS BIGINT) FROM bad) AS nonzero_first_year
"""


@register("row_contract", ROW_CONTRACT_SQL)
def q_row_contract(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "left").drop("c_custkey")         # D2 many-to-one
    counts = with_scalars(o.agg(F.count(F.lit(1)).alias("rows_before")), j.agg(F.count(F.lit(1)).alias("rows_after")))
    # Damaged input, so that every check has something to find.
    key = F.col("c_custkey")
    damaged = c.select(F.when(key % 97 != 0, key).alias("c_custkey")).unionByName(c.select(key).filter(key % 50 == 0))
    keys = key_violations(damaged, ["c_custkey"]).drop("duplicate_rows")       # J2
    order = F.col("o_orderkey")
    after = j.filter(order % 103 != 0).withColumn(
        "o_orderstatus", F.when(order % 101 == 0, F.lit("?")).otherwise(F.col("o_orderstatus")))
    after = after.unionByName(j.filter(order % 107 == 0).withColumn("o_orderkey", -order))
    kept = row_preservation(o, after, ["o_orderkey"], o.columns)                 # J3
    distinct = o.agg(F.count_distinct("o_custkey").alias("distinct_customers"))  # E22
    # F7 + J7: cumulative offspring counts never decrease along the target
    # years and start at 0; each (parent, role) series is bounded by the
    # number of years, so the window never holds a hot key's raw rows.
    off = materialize(_offspring(spark, sf_dir), "offspring")
    off = off.withColumn("PAST_OFFSPRING_COUNT", F.when(F.col("TARGET_YEAR") % 5 == 2, F.col("PAST_OFFSPRING_COUNT") - 1)
                         .otherwise(F.col("PAST_OFFSPRING_COUNT")))
    mono = quality.monotone_violations(off, ["LINEAGE_NO", "ROLE"], "TARGET_YEAR", "PAST_OFFSPRING_COUNT")
    y0 = off.agg(F.min("TARGET_YEAR").alias("__first"))          # one-row scalar
    first = with_scalars(off, y0).agg(
        F.count_if((F.col("TARGET_YEAR") == F.col("__first")) & (F.col("PAST_OFFSPRING_COUNT") != 0))
        .alias("nonzero_first_year"))
    mono = with_scalars(mono, first)
    out = with_scalars(counts, keys, kept, distinct, mono)
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in out.columns])


# --------------------------------------------------------------------------
# Row preservation by fingerprint (J3): a join that keeps all rows, and five
# kinds of damage, each against EXCEPT ALL.

_DAMAGES = {
    "left_join": ("o_totalprice", "true", ""),
    "lost": ("o_totalprice", "o_orderkey % 1009 <> 0", ""),
    "changed": ("CASE WHEN o_orderkey % 1013 = 0 THEN o_totalprice + 1 ELSE o_totalprice END", "true", ""),
    "repeated": ("o_totalprice", "true", "o_orderkey % 1019 = 0"),
    "repeated_for_lost": ("o_totalprice", "o_orderkey <> (SELECT min(o_orderkey) FROM orders)",
                          "o_orderkey = (SELECT max(o_orderkey) FROM orders)"),
    "set_missing": ("CASE WHEN o_orderkey % 1021 = 0 THEN NULL ELSE o_totalprice END", "true", ""),
}


def _row_fingerprint_sql() -> str:
    parts = []
    for name, (price, kept, again) in _DAMAGES.items():
        after = f"SELECT o_orderkey, o_custkey, {price} AS o_totalprice FROM orders WHERE {kept}"
        if again:
            after += f" UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE {again}"
        before = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"
        parts.append(f"""SELECT '{name}' AS step, (SELECT CAST(count(*) AS BIGINT) FROM orders) AS rows_before,
  (SELECT CAST(count(*) AS BIGINT) FROM ({after})) AS rows_after,
  (SELECT count(*) FROM (({before}) EXCEPT ALL ({after}))) + (SELECT count(*) FROM (({after}) EXCEPT ALL ({before}))) = 0 AS same_rows""")
    return "\nUNION ALL ".join(parts)


@register("row_fingerprint", _row_fingerprint_sql())
def q_row_fingerprint(spark, sf_dir):
    cols = ["o_orderkey", "o_custkey", "o_totalprice"]
    o = table(spark, sf_dir, "orders", *cols)
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    least, most = o.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    out = None
    for name, (price, kept, again) in _DAMAGES.items():
        own = [x.replace("(SELECT min(o_orderkey) FROM orders)", str(least))
               .replace("(SELECT max(o_orderkey) FROM orders)", str(most)) for x in (kept, again)]
        after = o.join(c, o.o_custkey == c.c_custkey, "left").filter(own[0]).withColumn("o_totalprice", F.expr(price))
        if again:
            after = after.select(*cols).unionByName(o.filter(own[1]))
        row = quality.same_rows(o, after, cols).select(F.lit(name).alias("step"), "*")
        out = row if out is None else out.unionByName(row)
    return out


# --------------------------------------------------------------------------
# Observation filter.

OBS_FILTER_SQL = """
WITH e AS (SELECT CAST(user_id % 10 AS INTEGER) AS stn, CASE WHEN value < 1 THEN NULL ELSE value END AS v FROM events),
st AS (SELECT DISTINCT CAST(c_nationkey % 10 AS INTEGER) AS stn FROM customer WHERE c_mktsegment = 'BUILDING'),
x AS (SELECT e.*, st.stn IS NOT NULL AS matched FROM e LEFT JOIN st ON e.stn = st.stn)
SELECT stn, matched, CAST(count(*) AS BIGINT) AS n_events, CAST(count_if(matched AND v IS NOT NULL) AS BIGINT) AS n_kept,
  round(sum(CASE WHEN matched THEN v END), 6) AS kept_sum
FROM x GROUP BY stn, matched
"""


@register("observation_filter", OBS_FILTER_SQL)
def q_observation_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events", "user_id", "value").select(
        (F.col("user_id") % 10).cast("int").alias("stn"), F.when(F.col("value") >= 1, F.col("value")).alias("v"))
    c = table(spark, sf_dir, "customer", "c_nationkey", "c_mktsegment")
    st = c.filter(F.col("c_mktsegment") == "BUILDING").select((F.col("c_nationkey") % 10).cast("int").alias("stn")) \
          .distinct().withColumn("__m", F.lit(True))
    x = e.join(st, "stn", "left").withColumn("matched", F.col("__m").isNotNull())   # D3 indicator
    kept = x.filter("matched").na.drop(subset=["v"])                                  # C11 + C6
    allc = x.groupBy("stn", "matched").agg(F.count(F.lit(1)).alias("n_events"))
    keptc = kept.groupBy("stn", "matched").agg(F.count(F.lit(1)).alias("n_kept"), F.sum("v").alias("kept_sum"))
    out = allc.join(keptc, ["stn", "matched"], "left").select(
        "stn", "matched", "n_events", F.coalesce(F.col("n_kept"), F.lit(0)).alias("n_kept"), "kept_sum")
    return round_doubles(out)


# --------------------------------------------------------------------------
# Semi / anti / full outer joins and set algebra.

SEMI_ANTI_SQL = """
SELECT
  (SELECT CAST(count(*) AS BIGINT) FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')) AS n_semi,
  (SELECT CAST(count(*) AS BIGINT) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')) AS n_anti,
  (SELECT CAST(count(*) AS BIGINT) FROM
     (SELECT o_custkey, count(*) AS nf FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
     FULL JOIN (SELECT o_custkey, count(*) AS no FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b
     ON a.o_custkey = b.o_custkey) AS n_full,
  (SELECT CAST(count(*) AS BIGINT) FROM
     (SELECT o_custkey, count(*) AS nf FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
     FULL JOIN (SELECT o_custkey, count(*) AS no FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b
     ON a.o_custkey = b.o_custkey WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL) AS n_one_sided,
  (SELECT CAST(count(*) AS BIGINT) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)) AS n_key_union,
  (SELECT CAST(count(*) AS BIGINT) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS n_customer_only,
  (SELECT CAST(count(*) AS BIGINT) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS n_order_only,
  (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT y FROM (SELECT year(o_orderdate) AS y FROM orders UNION ALL SELECT year(l_shipdate) FROM lineitem))) AS n_years,
  (SELECT CAST(min(y) AS INTEGER) FROM (SELECT year(o_orderdate) AS y FROM orders UNION ALL SELECT year(l_shipdate) FROM lineitem)) AS first_year
"""


@register("semi_anti_full", SEMI_ANTI_SQL)
def q_semi_anti_full(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey")
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_orderdate")
    li = table(spark, sf_dir, "lineitem", "l_shipdate")
    semi = c.join(o.filter(F.col("o_orderstatus") == "F"), c.c_custkey == o.o_custkey, "left_semi") \
            .agg(F.count(F.lit(1)).alias("n_semi"))                                            # D7
    anti = c.join(o.filter(F.col("o_orderstatus") == "P"), c.c_custkey == o.o_custkey, "left_anti") \
            .agg(F.count(F.lit(1)).alias("n_anti"))                                            # D8
    a = o.filter(F.col("o_orderstatus") == "F").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("nf"))
    b = o.filter(F.col("o_orderstatus") == "O").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("no"))
    full = a.join(b, "o_custkey", "full")                                                      # D4
    fullc = full.agg(F.count(F.lit(1)).alias("n_full"),
                     F.count_if(F.col("nf").isNull() | F.col("no").isNull()).alias("n_one_sided"))
    ck = c.select(F.col("c_custkey").alias("k"))
    ok = o.select(F.col("o_custkey").alias("k"))
    sets = with_scalars(ck.union(ok).distinct().agg(F.count(F.lit(1)).alias("n_key_union")),     # G2
                        ck.subtract(ok).agg(F.count(F.lit(1)).alias("n_customer_only")),
                        ok.subtract(ck).agg(F.count(F.lit(1)).alias("n_order_only")))
    yrs = target_years((o.select(F.year("o_orderdate").alias("y")), "y"),
                       (li.select(F.year("l_shipdate").alias("y")), "y"))                       # G3
    yrs = yrs.select(F.size("__years").cast("bigint").alias("n_years"),
                     F.element_at("__years", 1).cast("int").alias("first_year"))
    out = with_scalars(semi, anti, fullc, sets, yrs)
    return out.select(*[F.col(x).cast("bigint").alias(x) if x != "first_year" else F.col(x) for x in out.columns])


# --------------------------------------------------------------------------
# Summary by key with a NULL key group kept.

SUMMARY_SQL = """
WITH o AS (SELECT CASE WHEN o_orderstatus = 'P' AND o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS prio,
             o_totalprice, year(o_orderdate) AS y, o_custkey FROM orders)
SELECT prio, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 6) AS mean_price, round(avg(y), 6) AS mean_year,
  round(avg(o_custkey), 6) AS mean_customer
FROM o GROUP BY prio
"""


@register("summary_by_key", SUMMARY_SQL)
def q_summary_by_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
              "o_orderdate", "o_custkey")
    prio = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 9 == 0), F.lit(None)) \
            .otherwise(F.col("o_orderpriority"))
    s = o.groupBy(prio.alias("prio")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price"),
        F.avg(F.year("o_orderdate")).alias("mean_year"), F.avg("o_custkey").alias("mean_customer"))
    return round_doubles(s.orderBy(F.desc("n")))


# --------------------------------------------------------------------------
# Source union (G1, B24-B28, J10-J12): customers ("original") and suppliers
# ("smartfarm") normalised into one history schema.

def _union(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_name", "s_acctbal")
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    orig_addr = F.concat_ws(" ", "n_name", "c_mktsegment")
    co = c.join(n, c.c_nationkey == n.n_nationkey)
    parts = split_address(orig_addr)
    original = co.select(prefix_id("C", F.col("c_custkey").cast("string")).alias("CATTLE_NO"),
                         parts[0].alias("sido"), parts[1].alias("sigungu"), parts[2].alias("eupmyeondong"),
                         N.number_or_sentinel(F.when(F.col("c_acctbal") > 9000, F.lit("n/a"))
                                              .otherwise(F.col("c_acctbal").cast("string"))).alias("balance"),
                         F.lit(-99.0).alias("COST_AMT"), F.lit("original").alias("SOURCE"))
    so = s.join(n, s.s_nationkey == n.n_nationkey)
    addr = F.when(F.col("s_suppkey") % 7 == 0, F.lit("-99")).otherwise(F.concat_ws(" ", "n_name", "s_name", F.lit("x")))
    last_farm = F.when(F.col("s_suppkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("F"), F.col("s_suppkey").cast("string")))
    first_farm = F.concat(F.lit("G"), F.col("s_nationkey").cast("string"))
    sp = split_address(addr)
    smart = so.select(prefix_id("S", F.concat(F.col("s_suppkey").cast("string"), F.lit(".0"))).alias("CATTLE_NO"),
                      sp[0].alias("sido"), sp[1].alias("sigungu"), sp[2].alias("eupmyeondong"),
                      N.number_or_sentinel(F.col("s_acctbal").cast("string")).alias("balance"),
                      F.lit(-99.0).alias("COST_AMT"), F.lit("smartfarm").alias("SOURCE"),
                      coalesce_preferred(last_farm, first_farm).alias("FARM_UNIQUE_NO"))
    original = original.withColumn("FARM_UNIQUE_NO", F.concat(F.lit("C"), F.col("CATTLE_NO")))
    return original.unionByName(smart)                                                         # G1


UNION_SQL = """
WITH c AS (SELECT 'C' || CAST(c_custkey AS VARCHAR) AS CATTLE_NO, n_name AS sido, c_mktsegment AS sigungu, '-99' AS eupmyeondong,
             CASE WHEN c_acctbal > 9000 THEN -99.0 ELSE c_acctbal END AS balance, 'original' AS SOURCE,
             'CC' || CAST(c_custkey AS VARCHAR) AS FARM_UNIQUE_NO
           FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS CATTLE_NO,
        CASE WHEN s_suppkey % 7 = 0 THEN '-99' ELSE string_split_regex(n_name || ' ' || s_name || ' x', '\\s+')[1] END AS sido,
        CASE WHEN s_suppkey % 7 = 0 THEN '-99' ELSE coalesce(string_split_regex(n_name || ' ' || s_name || ' x', '\\s+')[2], '-99') END AS sigungu,
        CASE WHEN s_suppkey % 7 = 0 THEN '-99' ELSE coalesce(string_split_regex(n_name || ' ' || s_name || ' x', '\\s+')[3], '-99') END AS eupmyeondong,
        s_acctbal AS balance, 'smartfarm' AS SOURCE,
        CASE WHEN s_suppkey % 3 = 0 THEN 'G' || CAST(s_nationkey AS VARCHAR) ELSE 'F' || CAST(s_suppkey AS VARCHAR) END AS FARM_UNIQUE_NO
      FROM supplier JOIN nation ON s_nationkey = n_nationkey),
u AS (SELECT * FROM c UNION ALL SELECT * FROM s)
SELECT SOURCE, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count_if(NOT starts_with(CATTLE_NO, CASE SOURCE WHEN 'original' THEN 'C' ELSE 'S' END)) AS BIGINT) AS n_bad_prefix,
  CAST(count_if(balance = -99.0) AS BIGINT) AS n_missing_balance,
  CAST(count_if(eupmyeondong = '-99') AS BIGINT) AS n_missing_town,
  CAST(count(DISTINCT FARM_UNIQUE_NO) AS BIGINT) AS n_farms,
  round(sum(CASE WHEN balance = -99.0 THEN 0 ELSE balance END), 6) AS balance_sum,
  CAST(count_if(regexp_full_match(CATTLE_NO, '[CS][0-9]+')) AS BIGINT) AS n_pattern_ok
FROM u GROUP BY SOURCE
"""


@register("union_sources", UNION_SQL)
def q_union_sources(spark, sf_dir):
    u = _union(spark, sf_dir)
    prefix = F.when(F.col("SOURCE") == "original", F.lit("C")).otherwise(F.lit("S"))
    out = u.groupBy("SOURCE").agg(                                                             # J12
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("CATTLE_NO").startswith(prefix)).alias("n_bad_prefix"),           # J11
        F.count_if(F.col("balance") == -99.0).alias("n_missing_balance"),
        F.count_if(F.col("eupmyeondong") == "-99").alias("n_missing_town"),
        F.count_distinct("FARM_UNIQUE_NO").alias("n_farms"),
        F.sum(F.when(F.col("balance") == -99.0, F.lit(0.0)).otherwise(F.col("balance"))).alias("balance_sum"),
        F.count_if(F.col("CATTLE_NO").rlike("^[CS][0-9]+$")).alias("n_pattern_ok"))          # J10
    return round_doubles(out)


# --------------------------------------------------------------------------
# Row ids of all loaded rows in key order, then token-aware missing-row and date
# filters, which leave gaps in the ids (C1, C2, B30, F10, J16). The continuity
# check runs on the kept rows, some of whose ids are damaged first.

FIRST_SHIPPED = "1996-01-01"

ROW_IDS_SQL = f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS idx FROM lineitem),
k AS (SELECT *, 'TRAIN_' || lpad(CAST(idx AS VARCHAR), 9, '0') AS DATA_ROW_ID FROM r
      WHERE l_linenumber <> 7 AND l_shipdate >= DATE '{FIRST_SHIPPED}')
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, DATA_ROW_ID,
  (SELECT CAST(count_if(l_orderkey % 97 = 0) AS BIGINT) FROM k) AS id_mismatches,
  (SELECT CAST(max(idx) + 1 - count(*) AS BIGINT) FROM k) AS index_gaps,
  (SELECT CAST(count(*) AS BIGINT) FROM lineitem) AS loaded_rows,
  (SELECT CAST(count_if(l_linenumber = 7) AS BIGINT) FROM lineitem) AS dropped_rows
FROM k
"""


@register("row_ids", ROW_IDS_SQL)
def q_row_ids(spark, sf_dir):
    from herdflow.operators.rows import (date_floor_filter, dense_row_id, drop_rows_with_missing,
                                         format_row_id, id_continuity_violations)
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
               "l_shipdate")
    li = li.withColumn("flag_text", F.when(F.col("l_linenumber") == 7, F.lit("-99")).otherwise(F.col("l_returnflag")))
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    ids = dense_row_id(li.drop("l_returnflag"), key, "idx")                 # F10
    ids = ids.withColumn("DATA_ROW_ID", format_row_id("idx", "TRAIN"))      # B30
    kept, counts = drop_rows_with_missing(ids, ["flag_text"])               # C1
    kept = materialize(kept, "kept-rows")                                   # counted by this run (J14)
    kept = date_floor_filter(kept, start="l_shipdate", end="l_shipdate", min_start=FIRST_SHIPPED)   # C2
    damaged = kept.withColumn("DATA_ROW_ID", F.when(F.col("l_orderkey") % 97 == 0, F.lit("TRAIN_lost"))
                              .otherwise(F.col("DATA_ROW_ID")))
    check = id_continuity_violations(damaged, "idx", "DATA_ROW_ID", "TRAIN")  # J16
    return with_scalars(kept.select(*key, "DATA_ROW_ID"), check).withColumns(
        {"loaded_rows": F.lit(counts.get["loaded"]), "dropped_rows": F.lit(counts.get["dropped"])})
