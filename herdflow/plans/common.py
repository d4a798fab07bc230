"""Role mapping of the livestock model onto the driver's star-schema tables.

animal = lineitem row (l_orderkey, l_linenumber); farm = o_custkey;
province = nation name of the customer; slaughter date = l_shipdate;
birth date = o_orderdate; age = l_quantity; sex = l_returnflag;
score = p_size % 9 + 1; father = l_partkey; mother = l_suppkey;
station = event_type; reason text = documents.text;
group bridge = (c_mktsegment, c_nationkey).

Measures that are summed use whole-number values (prices floored, discount and
tax in percent) so sums and sums of squares are exact in double arithmetic and
do not depend on the order in which partitions are combined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from herdflow.sources.tables import table


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (result presentation only)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            # round(x * 10^d) / 10^d in IEEE doubles: the same arithmetic as
            # DuckDB's round(x, d), so exact decimal ties resolve identically.
            scale = float(10 ** digits)
            cols.append((F.round(F.col(f.name).cast("double") * F.lit(scale), 0) / F.lit(scale)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def animals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem with farm, province, dates and measures."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
               "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
               "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    # Orders find their customers first: the lineitem rows are dealt once, by order.
    farms = (orders.join(customer, F.col("o_custkey") == customer.c_custkey)
                   .join(nation, F.col("c_nationkey") == nation.n_nationkey))
    return (li.join(farms, li.l_orderkey == F.col("o_orderkey"))
              .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                      "l_returnflag", "l_linestatus", "o_custkey", "c_nationkey", "c_mktsegment",
                      F.col("n_name").alias("province"),
                      F.to_date("l_shipdate").alias("ship_date"),
                      F.to_date("o_orderdate").alias("birth_date"),
                      F.floor(F.col("l_extendedprice") / 100).cast("double").alias("weight"),
                      F.bround(F.col("l_discount") * 100, 0).alias("backfat"),
                      F.bround(F.col("l_tax") * 100, 0).alias("rea"),
                      F.col("l_linenumber").cast("double").alias("windex")))


# DuckDB fragment mirroring ``animals`` (used inside oracle SQL).
ANIMALS_SQL = """
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity,
         l.l_returnflag, l.l_linestatus, o.o_custkey, c.c_nationkey, c.c_mktsegment,
         n.n_name AS province,
         CAST(l.l_shipdate AS DATE) AS ship_date,
         CAST(o.o_orderdate AS DATE) AS birth_date,
         CAST(floor(l.l_extendedprice / 100) AS DOUBLE) AS weight,
         round_even(l.l_discount * 100, 0) AS backfat,
         round_even(l.l_tax * 100, 0) AS rea,
         CAST(l.l_linenumber AS DOUBLE) AS windex
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

SEASON_SQL = """CASE WHEN month({d}) IN (3,4,5) THEN '봄' WHEN month({d}) IN (6,7,8) THEN '여름'
 WHEN month({d}) IN (9,10,11) THEN '가을' WHEN month({d}) IN (12,1,2) THEN '겨울' END"""


def season_sql(expr: str) -> str:
    return SEASON_SQL.format(d=expr)
