"""Grade-class operators: add class columns, final grade decision, agreement."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdflow.functions import grades as G

CLASS_COLUMNS = {"insfat": "INSFAT_GRADE_CLASS", "yuksak": "YUKSAK_GRADE_CLASS",
                 "fatsak": "FATSAK_GRADE_CLASS", "tissue": "TISSUE_GRADE_CLASS",
                 "growth": "GROWTH_STATUS_CLASS"}


def add_grade_classes(df: DataFrame, scores: Mapping[str, str], variant: str = "builder",
                      names: Mapping[str, str] = CLASS_COLUMNS) -> DataFrame:
    """One class column per score column (``kind -> column``)."""
    missing = sorted(set(scores.values()) - set(df.columns))
    if missing:
        raise ValueError(f"data is missing grade score columns: {missing}")
    return df.withColumns({names[k]: G.grade_class(c, k, variant) for k, c in scores.items()})


def grade_decision(df: DataFrame, *, insfat: str, yuksak: str, fatsak: str, tissue: str,
                   growth: str, backfat: str, rea: str, weight: str, sex: str) -> DataFrame:
    """K7: quality (B43), yield index and grade (B41, B42) and final label."""
    return (df.withColumn("quality_final", G.quality_final(insfat, yuksak, fatsak, tissue, growth))
              .withColumn("yield_index", G.yield_index(backfat, rea, weight, sex))
              .withColumn("yield_grade", G.yield_grade("yield_index", sex))
              .withColumn("final_grade", F.when(F.col("quality_final").isNotNull()
                                                & F.col("yield_grade").isNotNull(),
                                                G.final_grade_label("quality_final", "yield_grade"))))


def grade_agreement(df: DataFrame, *, predicted: str, actual: str, quality: str,
                    yield_code: str, valid: list[str]) -> DataFrame:
    """Match rates of the final label and of its quality / yield parts
    over rows where every ``valid`` column is non-NULL (C10)."""
    cond = F.lit(True)
    for c in valid:
        cond = cond & F.col(c).isNotNull()
    # Conditional aggregation over a validity flag (not a filter): the flag
    # stays next to the aggregate instead of being pushed into upstream joins.
    v = df.withColumn("__valid", cond)
    ok = F.col("__valid")
    aq = G.grade_quality_part(F.col(actual))
    ay = G.grade_yield_part(F.col(actual))

    def rate(eq):
        return F.avg(F.when(ok, F.coalesce(eq, F.lit(False)).cast("double")))
    return v.agg(
        F.count_if(ok).alias("n_valid"),
        F.count_if(ok & (F.col(predicted) == F.col(actual))).alias("n_match"),
        rate(F.col(predicted) == F.col(actual)).alias("match_rate"),
        rate(F.col(quality) == aq).alias("quality_match_rate"),
        rate(F.col(yield_code) == ay).alias("yield_match_rate"))
