"""Annotation: attribute strings, qualifiers, their table and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a GFF or GTF line.
LINE = "seqid string, source string, type string, start int, end int, score string, strand string, phase string, attributes string"


def feature_id() -> F.Column:
    """Id of a feature made from all columns of its line."""
    return F.md5(F.concat_ws("\t", *[F.coalesce(F.col(c.split()[0]).cast("string"), F.lit(".")) for c in LINE.split(", ")]))


def attributes(lines: DataFrame, form: str) -> DataFrame:
    """Explode attribute strings: (feature_id, key, value). form: gff (key=value) or gtf (key "value").

    A GFF value ends at a second "=", blank parts and parts without the form's sign are skipped.
    """
    part = lines.select("feature_id", F.explode(F.split("attributes", ";")).alias("part")).where(F.trim("part") != "")
    if form == "gff":
        part = part.where(F.col("part").contains("="))
        key, value = F.split_part("part", F.lit("="), F.lit(1)), F.split_part("part", F.lit("="), F.lit(2))
    elif form == "gtf":
        part = part.where(F.col("part").contains('"'))
        key, value = F.regexp_extract("part", '^([^"]*)', 1), F.regexp_extract("part", '"([^"]*)"', 1)
    else:
        raise ValueError(f"form is gff or gtf, not {form!r}")
    return part.select("feature_id", F.trim(key).alias("key"), value.alias("value"))


def gff_features(lines: DataFrame, types: tuple[str, ...] = ("CDS",), one_based: bool = True) -> DataFrame:
    """Features of the wanted types as (chrom, fs, fe, fstrand, feature), half-open; one_based=False leaves starts as they are."""
    start = F.col("start") - (1 if one_based else 0)
    return lines.where(F.col("type").isin(*types)).select(F.col("seqid").alias("chrom"), start.alias("fs"), F.col("end").alias("fe"), F.col("strand").alias("fstrand"), F.col("feature_id").alias("feature"))


def key_proportions(qualifiers: DataFrame) -> DataFrame:
    """Part of all features that have each key."""
    n = qualifiers.agg(F.countDistinct("feature_id").alias("n"))
    per = qualifiers.groupBy("key").agg(F.countDistinct("feature_id").alias("features"))
    return per.join(F.broadcast(n), F.lit(True)).select("key", "features", (F.col("features") / F.col("n")).alias("proportion"))


def qualifier_table(qualifiers: DataFrame, keys: list[str] | None = None, minimum: float = 0.0, without: tuple[str, ...] = ("translation",)) -> DataFrame:
    """A row per feature, a column per key; values of a repeated key joined by ";". Keys held by `minimum` of features or less go."""
    q = qualifiers.where(~F.col("key").isin(*without))
    if keys is None:
        keys = [r["key"] for r in key_proportions(q).where(F.col("proportion") > minimum).orderBy("key").collect()]
    one = q.groupBy("feature_id", "key").agg(F.array_join(F.sort_array(F.collect_list("value")), ";").alias("value"))
    return one.groupBy(F.col("feature_id").alias("Feature id")).pivot("key", keys).agg(F.first("value"))


def locus_count(qualifiers: DataFrame, key: str = "locus_tag") -> DataFrame:
    return qualifiers.where(F.col("key") == key).agg(F.countDistinct("feature_id").alias("loci"))
