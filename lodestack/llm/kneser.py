"""Modified Kneser-Ney: discounts from counts of counts, and interpolation with one observation left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def estimates(*counts: Column) -> list[Column]:
    """d1, d2, d3 from the numbers of rows that were seen once, twice, three and four times."""
    n1, n2, n3, n4 = (F.greatest(c, F.lit(1)) for c in counts)
    y = n1 / (n1 + 2 * n2)
    keep = lambda d, most: F.least(F.greatest(d, F.lit(0.05)), F.lit(most))
    return [keep(1 - 2 * y * n2 / n1, 0.95).alias("d1"), keep(2 - 3 * y * n3 / n2, 1.95).alias("d2"), keep(3 - 4 * y * n4 / n3, 2.95).alias("d3")]


def discounts(level: DataFrame, *extra: Column) -> DataFrame:
    """lang, d1, d2, d3 (and ``extra`` aggregates) of a level's counts ``n``."""
    return level.groupBy("lang").agg(*estimates(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]), *extra)


def discount(n: Column) -> Column:
    """What a count gives up."""
    return F.when(n <= 0, 0.0).when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def probability(lower: Column) -> Column:
    """p of a row with its count n, its history's total and the mass ``left`` by discounts."""
    return (F.col("n") - discount(F.col("n"))) / F.col("total") + F.col("left") / F.col("total") * lower


def left_out(lower: Column, lower_out: Column) -> Column:
    """The same without one observation of the row; a row that only that one showed falls to the shorter history, which loses it too."""
    n, rest, total = F.col("n"), F.col("n") - 1, F.col("total") - 1
    below = F.when(rest > 0, lower).otherwise(lower_out)
    mass = F.col("left") - discount(n) + discount(rest)
    p = F.when(total > 0, F.greatest(rest - discount(rest), F.lit(0.0)) / total + mass / total * below)
    return F.when(p > 0, p).otherwise(below)
