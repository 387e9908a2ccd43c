"""Flags on guides: restriction sites, repeated seeds; raw guide lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import iupac_regex, reverse_complement_text

#: Row order of the scan: record, forward strand first, place.
ORDER = ["record_idx", "strand_order", "start"]


def flag_restriction_sites(targets: DataFrame, sites: list[str]) -> DataFrame:
    """hasrestrictionsite: the guide holds a site of the list, on either strand. Rows stay; no site flags nothing."""
    both = sorted({iupac_regex(m) for s in sites for m in (s, reverse_complement_text(s))})
    return targets.withColumn("hasrestrictionsite", F.col("target").rlike("|".join(both)) if both else F.lit(False))


def drop_restriction_sites(targets: DataFrame) -> DataFrame:
    return targets.where("not hasrestrictionsite")


def seed(target: Column, lsr: int, orientation: str) -> Column:
    """The `lsr` bases next to the motif; all of them if lsr is 0."""
    if lsr == 0:
        return target
    return F.right(target, F.lit(lsr)) if orientation == "3prime" else F.left(target, F.lit(lsr))


def flag_seeds(targets: DataFrame, lsr: int, orientation: str, strict: bool = False) -> DataFrame:
    """seedseq, and isseedduplicated: the seed stood in an earlier row (any other row with `strict`).

    The first row of a seed is found by a minimum that combines before the shuffle and is joined back, so a seed with
    very many rows is never sorted in one task.
    """
    place = F.struct("record_idx", (~F.col("strand")).cast("int").alias("strand_order"), "start")
    x = targets.withColumn("seedseq", seed(F.col("target"), lsr, orientation))
    first = x.groupBy(F.col("seedseq").alias("_seed")).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
    x = x.join(first, x["seedseq"] == first["_seed"])
    duplicated = F.col("_n") > 1 if strict else place != F.col("_first")
    return x.withColumn("isseedduplicated", duplicated).drop("_seed", "_first", "_n")


def first_of_seeds(targets: DataFrame, lsr: int, orientation: str, strict: bool = False) -> DataFrame:
    """The rows that `flag_seeds` does not flag, with its columns, without the others: the first row of each seed.

    Rows of a seed are put together before the shuffle, some 2^20 rows at a time, and again after it, so all rows are
    read once and neither kept nor joined.
    """
    x = targets.withColumn("seedseq", seed(F.col("target"), lsr, orientation)).withColumn("_n", F.lit(1).cast("long"))
    row = F.struct("record_idx", (~F.col("strand")).cast("int").alias("strand_order"), "start", F.struct(*targets.columns).alias("row"))
    x = x.mapInArrow(_combined, x.schema).repartition("seedseq").groupBy("seedseq").agg(F.min(row).alias("first"), F.sum("_n").alias("_n"))
    if strict:
        x = x.where("_n = 1")
    return x.select("first.row.*", "seedseq", F.lit(False).alias("isseedduplicated"))


def _combined(batches: Iterator[pa.RecordBatch], at_once: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= at_once:
            held = _firsts(held)
            rows = sum(map(len, held))
            if rows > at_once // 2:  # too many seeds to go on with
                yield from held
                held, rows = [], 0
    if rows:
        yield from _firsts(held)


def _firsts(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """The first row of each seed, and as its _n the sum of those of the seed's rows."""
    x = pa.Table.from_batches(batches).combine_chunks()
    seeds = np.asarray(x.column("seedseq").combine_chunks().dictionary_encode().indices)
    order = np.lexsort((np.asarray(x.column("start")), ~np.asarray(x.column("strand")), np.asarray(x.column("record_idx")), seeds))
    begins = np.flatnonzero(np.append(True, seeds[order][1:] != seeds[order][:-1]))
    n = np.add.reduceat(np.asarray(x.column("_n"))[order], begins)
    out, at = x.take(pa.array(order[begins])), x.schema.get_field_index("_n")
    return out.set_column(at, x.schema.field(at), pa.array(n, pa.int64())).combine_chunks().to_batches()


def export_bed(targets: DataFrame) -> DataFrame:
    """Seed-unique guides as (chrom, chromstart, chromend, name, strand)."""
    strand = F.when(F.col("strand"), "+").otherwise("-")
    return targets.where("not isseedduplicated").select(F.col("seqid").alias("chrom"), F.col("start").alias("chromstart"), F.col("stop").alias("chromend"), F.col("target").alias("name"), strand.alias("strand"))


def raw_guides(targets: DataFrame) -> DataFrame:
    """The raw guide list: seed-unique guides, without a distance filter."""
    return export_bed(targets).select(F.col("chrom").alias("Chromosome"), F.col("chromstart").alias("Start"), F.col("chromend").alias("Stop"), F.col("name").alias("gRNA"), F.col("strand").alias("Strand"))


def seed_rank(targets: DataFrame, lsr: int, orientation: str) -> DataFrame:
    """Number of each row among those of its seed, in the scan's order."""
    x = targets.withColumn("seedseq", seed(F.col("target"), lsr, orientation))
    order = Window.partitionBy("seedseq").orderBy("record_idx", F.col("strand").desc(), "start")
    return x.withColumn("seed_rank", F.row_number().over(order))
