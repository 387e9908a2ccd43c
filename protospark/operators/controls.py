"""Negative controls: random guides far from every target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .neighbors import knn

#: Candidates for each control wanted, rung by rung, and the distance at which the search ends.
LADDER, ENOUGH = (10, 100, 1000, 10000), 7


def genome_gc(sequences: DataFrame) -> DataFrame:
    """GC part of all A, C, G and T (each sequence weighs its length), and size in MiB: one row (gc, mib)."""
    gc, acgt = F.length(F.regexp_replace("seq", "[^GCSgcs]", "")), F.length(F.regexp_replace("seq", "[^ACGTSWacgtsw]", ""))
    n = F.length("seq")
    return sequences.agg((F.sum(F.try_divide(gc, acgt) * n) / F.sum(n)).alias("gc"), (F.sum(n) / (1024 * 1024)).alias("mib"))


def draw(seed: int, number: Column, place: Column) -> Column:
    """A number in [0, 1) that depends on its arguments alone."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), number.cast("string"), place.cast("string")))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def candidates(spark: SparkSession, n: int, length: int, gc: float, seed: int = 1) -> DataFrame:
    """n random guides (gen_idx, target) with G and C at the genome's rate; the same for the same seed."""

    def base(i: Column) -> Column:
        u = draw(seed, F.col("id"), i)
        half = F.lit(gc / 2)
        return F.when(u < half, "G").when(u < F.lit(gc), "C").when(u < F.lit(gc + (1 - gc) / 2), "A").otherwise("T")

    return spark.range(n).select(F.col("id").alias("gen_idx"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), base), "").alias("target"))


def top_controls(drawn: DataFrame, targets: DataFrame, n: int, dtype: str = "hamming") -> DataFrame:
    """The n candidates farthest from their nearest target: (gen_idx, target, dist)."""
    near = knn(drawn, targets, 1, dtype).select("target", "dist")
    return drawn.join(near, "target").select("gen_idx", "target", "dist").orderBy(F.desc("dist"), "gen_idx").limit(n)


def controls(sequences: DataFrame, targets: DataFrame, n: int = 1000, length: int = 20, dtype: str = "hamming", seed: int = 1, ladder: tuple[int, ...] = LADDER, enough: int = ENOUGH) -> tuple[DataFrame, dict]:
    """Controls (name, Sequences, Hamming distance), and their least and median distance.

    More candidates are drawn rung by rung until the n farthest are all `enough` away; the last rung's result stands
    even if they are not.
    """
    spark = sequences.sparkSession
    gc = genome_gc(sequences).first()["gc"] or 0.5
    for times in ladder:
        best = top_controls(candidates(spark, n * times, length, gc, seed), targets, n, dtype).persist()
        stats = best.agg(F.min("dist").alias("min"), F.median("dist").alias("median")).first().asDict()
        if times == ladder[-1] or (stats["min"] or 0) >= enough:
            break
        best.unpersist()
    name = F.concat(F.lit("Cont-"), F.md5("target"))
    out = best.select(name.alias("name"), F.col("target").alias("Sequences"), F.col("dist").cast("double").alias("Hamming distance"))
    return out, stats
