"""Yearly counts: trend, rank and change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tidy(table: DataFrame, serial: str, name: str, years: list[str]) -> DataFrame:
    """Rows whose serial is a number (others are subtotals), one per year."""
    kept = table.where(F.col(serial).try_cast("int").isNotNull())
    pairs = F.array(*[F.struct(F.lit(int(y)).alias("year"), F.col(f"`{y}`").try_cast("long").alias("n")) for y in years])
    return kept.select(F.col(name).alias("area"), F.explode(pairs).alias("p")).select("area", "p.year", "p.n")


def trends(counts: DataFrame) -> DataFrame:
    """counts(area, year, n) -> change against the year before and rank in the year."""
    w = Window.partitionBy("area").orderBy("year")
    before = F.lag("n").over(w)
    rank = F.rank().over(Window.partitionBy("year").orderBy(F.desc("n"), "area"))
    return counts.select("area", "year", "n", F.round(F.try_divide((F.col("n") - before) * 100.0, before), 4).alias("change_percent"), rank.alias("rank"))
