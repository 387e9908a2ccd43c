"""Aggregates that reports and plots are drawn from."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_stats(targets: DataFrame) -> DataFrame:
    """Counts of targets, distinct guides, repeated seeds and flagged sites, in one pass: one row."""
    return targets.agg(
        F.count(F.lit(1)).alias("targets"),
        F.countDistinct("target").alias("distinct_guides"),
        F.count_if("isseedduplicated").alias("seed_duplicates"),
        F.count_if("hasrestrictionsite").alias("with_site"),
    )


def design_stats(targets: DataFrame, table: DataFrame, sites_dropped: bool = False) -> DataFrame:
    """What a run reports of its result, one row: run_stats, guides removed for a restriction site, rows of the guide table and how many of them lie in their feature.

    targets: the scan with its flags, sites still in it; `sites_dropped` says whether the design left flagged guides out.
    """
    kept = table.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("Feature distance") == 0).alias("zero_distance"))
    removed = F.col("with_site") if sites_dropped else F.lit(0).cast("long")
    return run_stats(targets).withColumn("removed", removed).join(F.broadcast(kept), F.lit(True))


def accession(table: DataFrame, name: str) -> DataFrame:
    """The guide table of one sequence, as plots take it."""
    return table.where(F.col("Accession") == name)


def table_densities(table: DataFrame, points: int = 200) -> DataFrame:
    """Densities of guides and of features along each accession of the guide table: (chrom, kind, x, density).

    Both run from 1 to the accession's last feature end, with a bandwidth of a 200th of it; kind is guide or feature.
    """
    ends = table.groupBy(F.col("Accession").alias("chrom")).agg(F.max("Feature end").alias("extent"))
    parts = []
    for kind in ("guide", "feature"):
        places = table.select(F.col("Accession").alias("chrom"), F.col(f"{kind.title()} start").alias("pos")).join(ends, "chrom")
        parts.append(density(places, points).select("chrom", F.lit(kind).alias("kind"), "x", "density"))
    return parts[0].unionByName(parts[1])


def locus_pam_counts(table: DataFrame, key: str = "locus_tag") -> DataFrame:
    return table.groupBy(key, "PAM").agg(F.count(F.lit(1)).alias("guides"))


def density(places: DataFrame, points: int = 200) -> DataFrame:
    """Gaussian density of (chrom, pos) on a grid of `points` places from 1 to each chromosome's `extent`: (chrom, x, density).

    places: (chrom, pos, extent). The bandwidth is extent / 200, rounded. Places are first counted per grid cell, and only
    cells within five bandwidths of a grid point meet it, so the join is bounded by the grid and not by the places.
    """
    grid = places.groupBy("chrom").agg(F.max("extent").alias("extent"), F.count(F.lit(1)).alias("n"))
    grid = grid.withColumn("h", F.greatest(F.lit(1.0), F.round(F.col("extent") / 200))).withColumn("step", F.greatest((F.col("extent") - 1) / (points - 1), F.lit(1e-9)))
    counted = places.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(grid), "chrom")
    # a grid point at exactly five bandwidths belongs to them, which a quotient's rounding may miss: so one more on each side is tested
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - 5 * F.col("h") - 1) / F.col("step")) - 1)
    last = F.least(F.lit(points - 1), F.floor((F.col("pos") + 5 * F.col("h") - 1) / F.col("step")) + 1)
    x = counted.where(first <= last).withColumn("k", F.explode(F.sequence(first, last))).withColumn("x", 1 + F.col("k") * F.col("step"))
    x = x.where(F.abs(F.col("x") - F.col("pos")) <= 5 * F.col("h"))
    z = (F.col("x") - F.col("pos")) / F.col("h")
    kernel = F.exp(-z * z / 2) / (F.col("h") * math.sqrt(2 * math.pi))
    return x.groupBy("chrom", "x").agg((F.sum(F.col("c") * kernel) / F.first("n")).alias("density"))
