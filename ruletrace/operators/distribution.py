"""Shape measures over distributions.

Every measure works on (keys, value, n) rows, where n counts the observations of a value.
Counting comes first and combines map-side, so what is windowed afterwards has one row per
distinct value, however many observations there are and however skewed the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ruletrace.session import settled


def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))


def spread(counts: DataFrame, keys: list[str], value: str, *also: Column) -> DataFrame:
    """Per key: observations, least, upper median and greatest value.

    The upper median is the element at position n // 2 of the sorted values. ``also`` adds
    aggregates over the same rows.
    """
    return _running(counts, keys, value).groupBy(*keys).agg(*_spread_measures(value), *also)


def _running(counts: DataFrame, keys: list[str], value: str, width: int = 1) -> DataFrame:
    """Bins, and running totals up to each value and through each bin.

    Empty bins add nothing to a running total, so they need not exist here.
    """
    w = Window.partitionBy(*keys)
    return (counts.withColumn("_edge", _bin(value, width))
            .withColumns({"_all": F.sum("n").over(w),
                          "_upto": F.sum("n").over(w.orderBy(value).rowsBetween(
                              Window.unboundedPreceding, Window.currentRow)),
                          "_through": F.sum("n").over(w.orderBy("_edge").rangeBetween(
                              Window.unboundedPreceding, Window.currentRow))}))


def _spread_measures(value: str) -> list[Column]:
    at_middle = F.col("_upto") > F.floor(F.col("_all") / 2)
    return [F.max("_all").alias("observations"), F.min(value).alias("least"),
            F.min(F.when(at_middle, F.col(value))).alias("upper_median"),
            F.max(value).alias("greatest")]


def _edge_measures(tail: float) -> list[Column]:
    over = F.col("_through") > F.col("_all") * F.lit(float(tail))
    return [F.min(F.when(over, F.col("_edge"))).alias("edge"),
            F.coalesce(F.sum(F.when(~over, F.col("n"))), F.lit(0)).alias("below")]


def _bin(value: str, width: int) -> Column:
    return (F.floor(F.col(value) / width) * width).cast("bigint")


def binned(counts: DataFrame, keys: list[str], value: str, width: int) -> DataFrame:
    """Counts per left bin edge; only bins that hold something."""
    return counts.groupBy(*keys, _bin(value, width).alias("edge")).agg(F.sum("n").alias("n"))


def histogram(counts: DataFrame, keys: list[str], value: str, width: int,
              bins: int | None = None) -> DataFrame:
    """Counts of every bin from zero to the top one, empty bins included.

    ``bins`` keeps only the first ones, as a report head does.
    """
    filled = settled(binned(counts, keys, value, width), "bins")  # read twice, and few against what was counted
    top = F.max("edge")
    if bins is not None:
        top = F.least(top, F.lit((bins - 1) * width))
    edges = (filled.groupBy(*keys).agg(top.alias("_top"))
             .select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), "_top",
                                                 F.lit(width).cast("bigint"))).alias("edge")))
    return (edges.join(filled, [*keys, "edge"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))))


def left_edge(counts: DataFrame, keys: list[str], value: str, width: int,
              tail: float, *also: Column) -> DataFrame:
    """Per key, the first bin whose running total passes ``tail`` of all observations.

    ``below`` counts what lies under it; a floor with nothing below is hard. The spread
    measures come from the same pass, and ``also`` adds aggregates over the same rows.
    """
    return (_running(counts, keys, value, width).groupBy(*keys)
            .agg(*_spread_measures(value), *_edge_measures(tail), *also)
            .withColumn("floor", F.when(F.col("below") == 0, F.lit("hard")).otherwise(F.lit("soft"))))


def right_edge(counts: DataFrame, keys: list[str], value: str, cliff_ratio: float) -> DataFrame:
    """Per key, whether counts pile up at the greatest value (cliff) or thin out (taper)."""
    top = F.max(value).over(Window.partitionBy(*keys))
    return (counts.withColumn("_top", top).groupBy(*keys)
            .agg(F.max(value).alias("observed_max"),
                 F.sum("n").alias("observations"),
                 F.sum(F.when(F.col(value) == F.col("_top"), F.col("n"))).alias("count_at_max"),
                 F.coalesce(F.sum(F.when(F.col(value) == F.col("_top") - 1, F.col("n"))), F.lit(0))
                 .alias("count_below_max"),
                 F.max("n").alias("_peak"),
                 F.count("*").alias("distinct_values"))
            .withColumn("share_at_max", F.col("count_at_max") / F.col("observations"))
            .withColumn("max_over_peak", F.col("count_at_max") / F.col("_peak"))
            .withColumn("shape", F.when(F.col("max_over_peak") >= cliff_ratio, F.lit("cliff"))
                        .otherwise(F.lit("taper")))
            .drop("_peak"))
