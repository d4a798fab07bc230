"""Grade rules, yield grade, final grade agreement, seasons, tokens, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from herdflow.functions import dates as D
from herdflow.functions import grades as G
from herdflow.functions import nulls as N
from herdflow.functions import rows as R
from herdflow.operators.grades import CLASS_COLUMNS, add_grade_classes, grade_agreement, grade_decision
from herdflow.operators.quality import missing_profile
from herdflow.plans.common import round_doubles, season_sql
from herdflow.plans.registry import register
from herdflow.sources.tables import table

# --------------------------------------------------------------------------
# Score text per lineitem, derived from the part size (1..9) with missing
# tokens and junk text mixed in, so the token rules are exercised.

def _scored(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
               "l_returnflag", "l_discount", "l_tax", "l_quantity")
    part = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    j = li.join(part, li.l_partkey == part.p_partkey)

    def score(shift):
        s = (F.col("p_size") + F.lit(shift)) % 9 + 1
        return (F.when(F.col("l_linenumber") == 7, F.lit("-99"))
                 .when(F.col("l_linenumber") == 6, F.lit(" MISSING "))
                 .when((F.col("l_orderkey") % 17) == 0, F.lit("x"))
                 .otherwise(s.cast("string")))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_discount", "l_tax",
                    "l_quantity", "p_size", "p_retailprice",
                    score(0).alias("INSFAT"), score(1).alias("YUKSAK"), score(2).alias("FATSAK"),
                    score(3).alias("TISSUE"), score(4).alias("GROWTH"))


_SCORED_SQL = """
  SELECT l_orderkey, l_linenumber, l_returnflag, l_discount, l_tax, l_quantity, p_size, p_retailprice,
    {s0} AS INSFAT, {s1} AS YUKSAK, {s2} AS FATSAK, {s3} AS TISSUE, {s4} AS GROWTH
  FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def _score_sql(shift):
    return (f"CASE WHEN l_linenumber = 7 THEN '-99' WHEN l_linenumber = 6 THEN ' MISSING ' "
            f"WHEN l_orderkey % 17 = 0 THEN 'x' ELSE CAST((p_size + {shift}) % 9 + 1 AS VARCHAR) END")


SCORED_SQL = _SCORED_SQL.format(**{f"s{i}": _score_sql(i) for i in range(5)})
SCORES = {"insfat": "INSFAT", "yuksak": "YUKSAK", "fatsak": "FATSAK", "tissue": "TISSUE", "growth": "GROWTH"}


def _num_sql(c):
    return f"TRY_CAST(CASE WHEN trim({c}) IN ('', '-99', '-99.0', 'MISSING') THEN NULL ELSE trim({c}) END AS DOUBLE)"


def _missing(c):
    return f"trim({c}) IN ('', '-99', '-99.0', 'MISSING')"


def _builder_sql():
    i, y, f, t, g = (_num_sql(c) for c in ("INSFAT", "YUKSAK", "FATSAK", "TISSUE", "GROWTH"))
    return f"""
SELECT l_orderkey, l_linenumber,
 coalesce(CAST(CASE WHEN {_missing('INSFAT')} THEN NULL WHEN {i} IN (7,8,9) THEN 0 WHEN {i} = 6 THEN 1
   WHEN {i} IN (4,5) THEN 2 WHEN {i} IN (2,3) THEN 3 WHEN {i} = 1 THEN 4 END AS VARCHAR), 'MISSING') AS INSFAT_GRADE_CLASS,
 coalesce(CAST(CASE WHEN {_missing('YUKSAK')} THEN NULL WHEN {y} IN (3,4,5) THEN 0 WHEN {y} IN (2,6) THEN 1
   WHEN {y} = 1 THEN 2 WHEN {y} = 7 THEN 3 ELSE 4 END AS VARCHAR), 'MISSING') AS YUKSAK_GRADE_CLASS,
 coalesce(CAST(CASE WHEN {_missing('FATSAK')} THEN NULL WHEN {f} IN (1,2,3,4) THEN 0 WHEN {f} = 5 THEN 1
   WHEN {f} = 6 THEN 2 WHEN {f} = 7 THEN 3 ELSE 4 END AS VARCHAR), 'MISSING') AS FATSAK_GRADE_CLASS,
 coalesce(CAST(CASE WHEN {_missing('TISSUE')} THEN NULL WHEN {t} = 1 THEN 0 WHEN {t} = 2 THEN 1 WHEN {t} = 3 THEN 2
   WHEN {t} = 4 THEN 3 WHEN {t} = 5 THEN 4 END AS VARCHAR), 'MISSING') AS TISSUE_GRADE_CLASS,
 coalesce(CAST(CASE WHEN {_missing('GROWTH')} THEN NULL WHEN {g} IN (1,2,3,4,5,6,7) THEN 0
   WHEN {g} IN (8,9) THEN 1 END AS VARCHAR), 'MISSING') AS GROWTH_STATUS_CLASS
FROM ({SCORED_SQL})
"""


@register("grade_class_builder", _builder_sql())
def q_grade_class_builder(spark, sf_dir):
    df = add_grade_classes(_scored(spark, sf_dir), SCORES, variant="builder")
    cls = list(CLASS_COLUMNS.values())
    return df.select("l_orderkey", "l_linenumber", *[N.missing_out(c).alias(c) for c in cls])


def _numeric_scores(spark, sf_dir):
    """The tabular and sequence learners read numeric scores: the text scores
    with missing marks, -99 and junk cleaned (B3, B4)."""
    return _scored(spark, sf_dir).withColumns({c: N.sentinel_to_null(N.to_number(c)) for c in SCORES.values()})


def _tabular_sql():
    i, y, f, t, g = (f"CAST({_num_sql(c)} AS INTEGER)" for c in ("INSFAT", "YUKSAK", "FATSAK", "TISSUE", "GROWTH"))
    return f"""
SELECT l_orderkey, l_linenumber,
 CAST(CASE WHEN {i} IS NULL THEN NULL WHEN {i} >= 7 THEN 0 WHEN {i} = 6 THEN 1 WHEN {i} >= 4 THEN 2
   WHEN {i} >= 2 THEN 3 ELSE 4 END AS BIGINT) AS y_insfat,
 CAST(CASE WHEN {y} IS NULL THEN NULL WHEN {y} IN (3,4,5) THEN 0 WHEN {y} IN (2,6) THEN 1 WHEN {y} = 1 THEN 2
   WHEN {y} = 7 THEN 3 ELSE 4 END AS BIGINT) AS y_yuksak,
 CAST(CASE WHEN {f} IS NULL THEN NULL WHEN {f} <= 4 THEN 0 WHEN {f} = 5 THEN 1 WHEN {f} = 6 THEN 2
   WHEN {f} = 7 THEN 3 ELSE 4 END AS BIGINT) AS y_fatsak,
 CAST(CASE WHEN {t} IS NULL THEN NULL WHEN {t} = 1 THEN 0 WHEN {t} = 2 THEN 1 WHEN {t} = 3 THEN 2
   WHEN {t} = 4 THEN 3 ELSE 4 END AS BIGINT) AS y_tissue,
 CAST(CASE WHEN {g} IS NULL THEN NULL WHEN {g} >= 8 THEN 1 ELSE 0 END AS BIGINT) AS y_growth
FROM ({SCORED_SQL})
"""


TABULAR_NAMES = {"insfat": "y_insfat", "yuksak": "y_yuksak", "fatsak": "y_fatsak",
                 "tissue": "y_tissue", "growth": "y_growth"}
SEQUENCE_NAMES = {"insfat": "target_insfat", "yuksak": "target_yuksak", "fatsak": "target_fatsak",
                  "tissue": "target_tissue", "growth": "target_growth"}


@register("grade_class_tabular", _tabular_sql())
def q_grade_class_tabular(spark, sf_dir):
    df = add_grade_classes(_numeric_scores(spark, sf_dir), SCORES, variant="tabular", names=TABULAR_NAMES)
    return df.select("l_orderkey", "l_linenumber",
                     *[F.col(c).cast("bigint").alias(c) for c in TABULAR_NAMES.values()])


def _sequence_sql():
    i, y, f, t, g = (_num_sql(c) for c in ("INSFAT", "YUKSAK", "FATSAK", "TISSUE", "GROWTH"))
    return f"""
SELECT l_orderkey, l_linenumber,
 CAST(CASE WHEN {i} IS NULL THEN NULL WHEN {i} >= 7 THEN 0 WHEN {i} = 6 THEN 1 WHEN {i} >= 4 THEN 2
   WHEN {i} >= 2 THEN 3 ELSE 4 END AS BIGINT) AS target_insfat,
 CAST(CASE WHEN {y} IS NULL THEN NULL WHEN {y} <= 3 THEN 0 WHEN {y} <= 5 THEN 1 ELSE 2 END AS BIGINT) AS target_yuksak,
 CAST(CASE WHEN {f} IS NULL THEN NULL WHEN {f} <= 2 THEN 0 WHEN {f} = 3 THEN 1 ELSE 2 END AS BIGINT) AS target_fatsak,
 CAST(CAST(trunc({t}) AS INTEGER) - 1 AS BIGINT) AS target_tissue,
 CAST(CASE WHEN {g} IS NULL THEN NULL WHEN {g} <= 3 THEN 0 WHEN {g} <= 6 THEN 1 ELSE 2 END AS BIGINT) AS target_growth
FROM ({SCORED_SQL})
"""


@register("grade_class_sequence", _sequence_sql())
def q_grade_class_sequence(spark, sf_dir):
    df = add_grade_classes(_numeric_scores(spark, sf_dir), SCORES, variant="sequence", names=SEQUENCE_NAMES)
    return df.select("l_orderkey", "l_linenumber",
                     *[F.col(c).cast("bigint").alias(c) for c in SEQUENCE_NAMES.values()])


# --------------------------------------------------------------------------
# Yield index / grade and final decision.

SEX_SQL = "CASE l_returnflag WHEN 'A' THEN '암' WHEN 'N' THEN '수' WHEN 'R' THEN '거세' END"


def _sex():
    return (F.when(F.col("l_returnflag") == "A", F.lit(G.SEX_FEMALE))
             .when(F.col("l_returnflag") == "N", F.lit(G.SEX_BULL))
             .when(F.col("l_returnflag") == "R", F.lit(G.SEX_STEER)))


def _yield_inputs(spark, sf_dir):
    df = _numeric_scores(spark, sf_dir)
    return df.withColumns({
        "sex": _sex(),
        "backfat": F.bround(F.col("l_discount") * 100, 0) + F.lit(5.0),
        "rea": F.col("l_quantity") + F.lit(60.0),
        "weight": F.bround(F.col("p_retailprice") / 4, 0) + F.lit(150.0),
    })


_YIELD_BASE_SQL = f"""
  SELECT *, {SEX_SQL} AS sex, round_even(l_discount * 100, 0) + 5.0 AS backfat,
         l_quantity + 60.0 AS rea, round_even(p_retailprice / 4, 0) + 150.0 AS weight
  FROM ({SCORED_SQL})
"""

YI_SQL = """CASE sex WHEN '암' THEN (6.90137::DOUBLE + -0.94460::DOUBLE * backfat + 0.31805::DOUBLE * rea + 0.54952::DOUBLE * weight) / weight * 100.0::DOUBLE
 WHEN '수' THEN (0.20103::DOUBLE + -2.18525::DOUBLE * backfat + 0.29275::DOUBLE * rea + 0.64099::DOUBLE * weight) / weight * 100.0::DOUBLE
 WHEN '거세' THEN (11.06398::DOUBLE + -1.25149::DOUBLE * backfat + 0.28293::DOUBLE * rea + 0.56781::DOUBLE * weight) / weight * 100.0::DOUBLE END"""

YG_SQL = """CASE WHEN yi IS NULL OR sex IS NULL THEN NULL
 WHEN sex = '암' THEN CASE WHEN yi >= 61.83 THEN 0 WHEN yi >= 59.70 THEN 1 ELSE 2 END
 WHEN sex = '수' THEN CASE WHEN yi >= 68.45 THEN 0 WHEN yi >= 66.32 THEN 1 ELSE 2 END
 WHEN sex = '거세' THEN CASE WHEN yi >= 62.52 THEN 0 WHEN yi >= 60.40 THEN 1 ELSE 2 END END"""

YIELD_GRADE_SQL = f"""
WITH b AS ({_YIELD_BASE_SQL}),
y AS (SELECT l_orderkey, l_linenumber, sex, CAST({YI_SQL} AS DOUBLE) AS yi FROM b)
SELECT l_orderkey, l_linenumber, round(yi, 6) AS yield_index, CAST({YG_SQL} AS BIGINT) AS yield_grade,
       ['A','B','C'][({YG_SQL}) + 1] AS yield_letter
FROM y
"""


@register("yield_grade", YIELD_GRADE_SQL)
def q_yield_grade(spark, sf_dir):
    df = _yield_inputs(spark, sf_dir)
    df = df.withColumn("yield_index", G.yield_index("backfat", "rea", "weight", "sex").cast("double"))
    df = df.withColumn("yield_grade", G.yield_grade("yield_index", "sex").cast("bigint"))
    yn = F.array(*[F.lit(x) for x in G.YIELD_NAMES])
    return round_doubles(df.select("l_orderkey", "l_linenumber", "yield_index", "yield_grade",
                                   F.get(yn, F.col("yield_grade").cast("int")).alias("yield_letter")))


def _decided(spark, sf_dir):
    df = add_grade_classes(_yield_inputs(spark, sf_dir), SCORES, variant="tabular", names=TABULAR_NAMES)
    df = grade_decision(df, insfat="y_insfat", yuksak="y_yuksak", fatsak="y_fatsak", tissue="y_tissue",
                        growth="y_growth", backfat="backfat", rea="rea", weight="weight", sex="sex")
    # "Actual" label: quality from the part size, yield from the order key.
    qn = F.array(*[F.lit(x) for x in G.QUALITY_NAMES])
    yn = F.array(*[F.lit(x) for x in G.YIELD_NAMES])
    actual = F.concat(F.get(qn, (F.col("p_size") % 5).cast("int")), F.get(yn, (F.col("l_orderkey") % 3).cast("int")))
    return df.withColumn("LAST_GRADE", actual)


def _tab_expr(c, kind):
    v = f"CAST({_num_sql(c)} AS INTEGER)"
    return {
        "insfat": f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} >= 7 THEN 0 WHEN {v} = 6 THEN 1 WHEN {v} >= 4 THEN 2 WHEN {v} >= 2 THEN 3 ELSE 4 END",
        "yuksak": f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} IN (3,4,5) THEN 0 WHEN {v} IN (2,6) THEN 1 WHEN {v} = 1 THEN 2 WHEN {v} = 7 THEN 3 ELSE 4 END",
        "fatsak": f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} <= 4 THEN 0 WHEN {v} = 5 THEN 1 WHEN {v} = 6 THEN 2 WHEN {v} = 7 THEN 3 ELSE 4 END",
        "tissue": f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} = 1 THEN 0 WHEN {v} = 2 THEN 1 WHEN {v} = 3 THEN 2 WHEN {v} = 4 THEN 3 ELSE 4 END",
        "growth": f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} >= 8 THEN 1 ELSE 0 END",
    }[kind]


DECIDED_SQL = f"""
  WITH b AS ({_YIELD_BASE_SQL}),
  c AS (SELECT *, {_tab_expr('INSFAT', 'insfat')} AS y_insfat, {_tab_expr('YUKSAK', 'yuksak')} AS y_yuksak,
          {_tab_expr('FATSAK', 'fatsak')} AS y_fatsak, {_tab_expr('TISSUE', 'tissue')} AS y_tissue,
          {_tab_expr('GROWTH', 'growth')} AS y_growth, CAST({YI_SQL} AS DOUBLE) AS yi FROM b),
  d AS (SELECT *, greatest(y_insfat, y_yuksak, y_fatsak, y_tissue) AS qg, {YG_SQL} AS yg FROM c),
  e AS (SELECT *, CASE WHEN y_growth = 1 AND qg < 4 THEN qg + 1 ELSE qg END AS qf,
          ['1++','1+','1','2','3'][(p_size % 5) + 1] || ['A','B','C'][(l_orderkey % 3) + 1] AS last_grade FROM d)
  SELECT *, CASE WHEN qf IS NOT NULL AND yg IS NOT NULL THEN ['1++','1+','1','2','3'][qf + 1] || ['A','B','C'][yg + 1] END AS fg FROM e
"""


FINAL_GRADE_MATCH_SQL = f"""
WITH f AS ({DECIDED_SQL}),
v AS (SELECT * FROM f WHERE y_insfat IS NOT NULL AND y_yuksak IS NOT NULL AND y_fatsak IS NOT NULL
        AND y_tissue IS NOT NULL AND y_growth IS NOT NULL AND yg IS NOT NULL AND last_grade IS NOT NULL)
SELECT CAST(count(*) AS BIGINT) AS n_valid,
  CAST(count_if(fg = last_grade) AS BIGINT) AS n_match,
  round(avg(CAST(coalesce(fg = last_grade, false) AS DOUBLE)), 6) AS match_rate,
  round(avg(CAST(coalesce(qf = CASE regexp_extract(last_grade, '^(1\\+\\+|1\\+|1|2|3)', 1)
      WHEN '1++' THEN 0 WHEN '1+' THEN 1 WHEN '1' THEN 2 WHEN '2' THEN 3 WHEN '3' THEN 4 END, false) AS DOUBLE)), 6) AS quality_match_rate,
  round(avg(CAST(coalesce(yg = CASE regexp_extract(last_grade, '([ABC])$', 1)
      WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 END, false) AS DOUBLE)), 6) AS yield_match_rate
FROM v
"""


@register("final_grade_match", FINAL_GRADE_MATCH_SQL)
def q_final_grade_match(spark, sf_dir):
    df = _decided(spark, sf_dir)
    out = grade_agreement(df, predicted="final_grade", actual="LAST_GRADE", quality="quality_final",
                          yield_code="yield_grade",
                          valid=["y_insfat", "y_yuksak", "y_fatsak", "y_tissue", "y_growth",
                                 "yield_grade", "LAST_GRADE"])
    return round_doubles(out)


SEX_GRADE_SUMMARY_SQL = f"""
WITH f AS ({DECIDED_SQL}),
full_rows AS (SELECT sex, yi, yg, CASE WHEN y_insfat IS NOT NULL AND y_growth IS NOT NULL THEN qf END AS qf_scattered,
   list_position([l_discount, l_tax, l_quantity / 1000.0], list_max([l_discount, l_tax, l_quantity / 1000.0])) - 1 AS am
   FROM f)
SELECT sex, round(avg(yi), 6) AS mean_index,
  CAST(count_if(yg = 0) AS BIGINT) AS n_a, CAST(count_if(yg = 1) AS BIGINT) AS n_b,
  CAST(count_if(yg = 2) AS BIGINT) AS n_c,
  CAST(count(qf_scattered) AS BIGINT) AS n_quality_known,
  CAST(count_if(am = 2) AS BIGINT) AS n_argmax_quantity
FROM full_rows GROUP BY sex
"""


@register("sex_grade_summary", SEX_GRADE_SUMMARY_SQL)
def q_sex_grade_summary(spark, sf_dir):
    df = _decided(spark, sf_dir)
    # Quality predictions exist only for the valid subset; scatter them
    # back onto every row by a left join on the row id (others stay NULL).
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    valid = df.filter(F.col("y_insfat").isNotNull() & F.col("y_growth").isNotNull()) \
              .select(*key, F.col("quality_final").alias("qf_scattered"))
    full = df.join(valid, key, "left")
    probs = F.array(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 1000.0)
    full = full.withColumn("am", G.argmax_label(probs))
    out = full.groupBy("sex").agg(
        F.avg("yield_index").alias("mean_index"),
        F.count_if(F.col("yield_grade") == 0).alias("n_a"),
        F.count_if(F.col("yield_grade") == 1).alias("n_b"),
        F.count_if(F.col("yield_grade") == 2).alias("n_c"),
        F.count("qf_scattered").alias("n_quality_known"),
        F.count_if(F.col("am") == 2).alias("n_argmax_quantity"))
    return round_doubles(out)


# --------------------------------------------------------------------------
# Seasons (B10, E6, E21).

SEASON_COUNTS_SQL = f"""
SELECT {season_sql('CAST(l_shipdate AS DATE)')} AS season,
  CAST(CASE WHEN month(l_shipdate) IN (12,1,2) THEN 0 WHEN month(l_shipdate) IN (3,4,5) THEN 1
    WHEN month(l_shipdate) IN (6,7,8) THEN 2 WHEN month(l_shipdate) IN (9,10,11) THEN 3 END AS INTEGER) AS season_idx,
  CAST(count(*) AS BIGINT) AS n,
  CAST(count(DISTINCT year(l_shipdate)) AS BIGINT) AS n_years
FROM lineitem GROUP BY 1, 2
"""


@register("season_counts", SEASON_COUNTS_SQL)
def q_season_counts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_shipdate").select(F.to_date("l_shipdate").alias("d"))
    return (li.groupBy(D.season_of("d").alias("season"), D.season_index("d").alias("season_idx"))
              .agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.year("d")).alias("n_years")))


# --------------------------------------------------------------------------
# Token profile.

def _tokenised(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    raw_cust = (F.when(F.col("o_orderkey") % 7 == 0, F.lit("-99"))
                 .when(F.col("o_orderkey") % 11 == 0, F.lit(" MISSING "))
                 .when(F.col("o_orderkey") % 13 == 0, F.lit(""))
                 .when(F.col("o_orderkey") % 19 == 0, F.lit("n/a"))
                 .otherwise(F.col("o_custkey").cast("string")))
    raw_prio = (F.when(F.col("o_orderkey") % 5 == 0, F.lit("-99.0"))
                 .otherwise(F.concat(F.lit("\t"), F.col("o_orderpriority"))))
    return o.select("o_orderkey", raw_cust.alias("cust_raw"), raw_prio.alias("prio_raw"))


TOKENISED_SQL = """
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 7 = 0 THEN '-99' WHEN o_orderkey % 11 = 0 THEN ' MISSING '
         WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN 'n/a'
         ELSE CAST(o_custkey AS VARCHAR) END AS cust_raw,
    CASE WHEN o_orderkey % 5 = 0 THEN '-99.0' ELSE chr(9) || o_orderpriority END AS prio_raw
  FROM orders
"""

NULL_TOKENS_PROFILE_SQL = f"""
WITH t AS ({TOKENISED_SQL}),
c AS (SELECT
   CASE WHEN trim(cust_raw) IN ('', '-99', '-99.0', 'MISSING') THEN NULL ELSE trim(cust_raw) END AS cust_tok,
   CASE WHEN trim(prio_raw, ' ' || chr(9)) IN ('', '-99', '-99.0', 'MISSING') THEN NULL ELSE trim(prio_raw, ' ' || chr(9)) END AS prio_tok
  FROM t),
n AS (SELECT cust_tok, TRY_CAST(cust_tok AS DOUBLE) AS cust_num, prio_tok FROM c)
SELECT * FROM (
  SELECT 'cust_num' AS column_name, CAST(count(*) - count(cust_num) AS BIGINT) AS n_missing,
         round(100.0 * (count(*) - count(cust_num)) / count(*), 6) AS pct_missing,
         CAST(count(cust_num) AS BIGINT) AS n_present FROM n
  UNION ALL
  SELECT 'cust_tok', CAST(count(*) - count(cust_tok) AS BIGINT), round(100.0 * (count(*) - count(cust_tok)) / count(*), 6),
         CAST(count(cust_tok) AS BIGINT) FROM n
  UNION ALL
  SELECT 'prio_tok', CAST(count(*) - count(prio_tok) AS BIGINT), round(100.0 * (count(*) - count(prio_tok)) / count(*), 6),
         CAST(count(prio_tok) AS BIGINT) FROM n)
"""


@register("null_tokens_profile", NULL_TOKENS_PROFILE_SQL)
def q_null_tokens_profile(spark, sf_dir):
    t = _tokenised(spark, sf_dir)
    cleaned = t.select(N.null_tokens("cust_raw").alias("cust_tok"),
                       N.to_number("cust_raw").alias("cust_num"),
                       N.null_tokens("prio_raw").alias("prio_tok"))
    return round_doubles(missing_profile(cleaned, ["cust_num", "cust_tok", "prio_tok"]))


# --------------------------------------------------------------------------
# Date parsing.

def _date_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    k = F.col("o_orderkey") % 6
    raw = (F.when(k == 0, F.date_format("o_orderdate", "yyyyMMdd"))
            .when(k == 1, F.date_format("o_orderdate", "yyyy.M.d"))
            .when(k == 2, F.date_format("o_orderdate", "yyyy/MM/dd"))
            .when(k == 3, F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd")))
            .when(k == 4, F.when(F.col("o_orderkey") % 4 == 0, F.lit("-99")).otherwise(F.lit("not a date")))
            .otherwise(F.date_format("o_orderdate", "yyyy-M-d")))
    return o.select("o_orderkey", raw.alias("raw_date"))


PARSE_DATES_SQL = """
WITH t AS (
  SELECT o_orderkey,
   CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d')
     WHEN 1 THEN CAST(year(o_orderdate) AS VARCHAR) || '.' || CAST(month(o_orderdate) AS VARCHAR) || '.' || CAST(day(o_orderdate) AS VARCHAR)
     WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d')
     WHEN 3 THEN ' ' || strftime(o_orderdate, '%Y-%m-%d')
     WHEN 4 THEN CASE WHEN o_orderkey % 4 = 0 THEN '-99' ELSE 'not a date' END
     ELSE CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) || '-' || CAST(day(o_orderdate) AS VARCHAR) END AS raw_date
  FROM orders),
s AS (SELECT o_orderkey, raw_date,
   CASE WHEN trim(raw_date) IN ('', '-99', '-99.0', 'MISSING') THEN NULL ELSE trim(raw_date) END AS s FROM t),
p AS (SELECT o_orderkey, raw_date, coalesce(
     CASE WHEN regexp_full_match(s, '\\d{8}') THEN CAST(try_strptime(s, '%Y%m%d') AS DATE) END,
     CASE WHEN regexp_full_match(s, '\\d{4}[./-]\\d{1,2}[./-]\\d{1,2}') THEN CAST(try_strptime(regexp_replace(s, '[./]', '-', 'g'), '%Y-%m-%d') AS DATE) END,
     TRY_CAST(s AS DATE)) AS d FROM s)
SELECT o_orderkey, raw_date, coalesce(strftime(d, '%Y-%m-%d'), 'MISSING') AS parsed,
  CAST(year(d) AS INTEGER) AS yr, CAST(month(d) AS INTEGER) AS mon, CAST(dayofyear(d) AS INTEGER) AS doy,
  coalesce({season}, 'MISSING') AS season
FROM p
""".replace("{season}", season_sql("d"))


@register("parse_dates", PARSE_DATES_SQL)
def q_parse_dates(spark, sf_dir):
    t = _date_text(spark, sf_dir)
    d = D.parse_date_multi("raw_date")
    return t.select("o_orderkey", "raw_date", D.format_date(d).alias("parsed"),
                    F.year(d).alias("yr"), F.month(d).alias("mon"), F.dayofyear(d).alias("doy"),
                    D.season_of(d).alias("season"))


# --------------------------------------------------------------------------
# Row sums, clipping, positive-only, zero fill.

ROW_SUMS_SQL = """
WITH b AS (
  SELECT l_orderkey, l_linenumber, round_even(l_discount * 100, 0) AS d, round_even(l_tax * 100, 0) AS t,
         CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity - 25 END AS q FROM lineitem)
SELECT l_orderkey, l_linenumber,
  coalesce(d, 0) + coalesce(t, 0) + coalesce(q, 0) AS row_total,
  CASE WHEN q IS NULL THEN NULL ELSE greatest(q, 0.0) END AS q_clipped,
  CAST(CASE WHEN q IS NULL THEN NULL ELSE least(greatest(CAST(q AS BIGINT), 0), 4) END AS BIGINT) AS q_class,
  CASE WHEN q > 0 THEN q END AS q_positive,
  coalesce(q, 0) AS q_filled,
  round(try_divide_placeholder, 6) AS share_known
FROM b
"""
ROW_SUMS_SQL = ROW_SUMS_SQL.replace(
    "try_divide_placeholder",
    "CASE WHEN coalesce(d, 0) + coalesce(t, 0) + coalesce(q, 0) = 0 THEN NULL "
    "ELSE (coalesce(d, 0) + coalesce(t, 0)) / (coalesce(d, 0) + coalesce(t, 0) + coalesce(q, 0)) END")


@register("row_sums_clipped", ROW_SUMS_SQL)
def q_row_sums_clipped(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")
    b = li.select("l_orderkey", "l_linenumber", F.bround(F.col("l_discount") * 100, 0).alias("d"),
                  F.bround(F.col("l_tax") * 100, 0).alias("t"),
                  F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity") - 25).alias("q"))
    total = R.row_sum(["d", "t", "q"])
    return round_doubles(b.select(
        "l_orderkey", "l_linenumber", total.alias("row_total"),
        R.clip_lower("q", 0.0).alias("q_clipped"),
        R.clip_range(F.col("q").cast("bigint"), 0, 4).cast("bigint").alias("q_class"),
        R.positive_only("q").alias("q_positive"),
        N.null_to_zero("q").cast("double").alias("q_filled"),
        R.safe_ratio(R.row_sum(["d", "t"]), total).alias("share_known")))


# --------------------------------------------------------------------------
# Grade texts of the two sources brought to one form.

_QUALITY = ["1++등급", "1+등급", "1등급", "2", "3등급", "등외등급", "등외", "-99", "", "특"]
_QUANTITY = ["A", "B", "C", "D", "E", "-99", "", "a"]


def _pick_sql(texts, key):
    return "CASE " + " ".join(f"WHEN {key} = {i} THEN '{t}'" for i, t in enumerate(texts)) + " END"


LAST_GRADES_SQL = f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_pick_sql(_QUALITY, 'l_partkey % 11')} AS q,
             {_pick_sql(_QUANTITY, 'l_suppkey % 9')} AS y FROM lineitem),
n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CASE WHEN q IN ('1++등급', '1+등급', '1등급', '2등급', '3등급', '등외등급') THEN replace(q, '등급', '') ELSE q END AS quality,
        CASE WHEN y IN ('A', 'B', 'C', 'D', '-99') THEN y ELSE '-99' END AS quantity FROM t)
SELECT *, CASE WHEN quality = '등외' THEN '등외' WHEN quality IS NULL OR quality IN ('-99', '') OR quantity IN ('-99', '') THEN '-99'
  ELSE quality || quantity END AS last_grade
FROM n
"""


@register("last_grades", LAST_GRADES_SQL)
def q_last_grades(spark, sf_dir):
    from herdflow.functions.grades import last_grade_compose, quality_grade_norm, quantity_grade_norm

    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    pick = lambda texts, key: F.get(F.array(*[F.lit(t) for t in texts]), key.cast("int"))
    raw = li.withColumns({"q": pick(_QUALITY, F.col("l_partkey") % 11), "y": pick(_QUANTITY, F.col("l_suppkey") % 9)})
    out = raw.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quality_grade_norm("q").alias("quality"),
                     quantity_grade_norm("y").alias("quantity"))
    return out.withColumn("last_grade", last_grade_compose("quality", "quantity"))
