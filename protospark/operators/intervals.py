"""Nearest features of guides, and the positional filter on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Bases of a bin: guides and features meet in bins.
BIN = 1 << 14
#: What is looked for in a bin: the feature after a guide, the one before it, and the first that overlaps it.
SIDES = ("after", "before", "over")


def _in_bins(rows: pa.Table, starts: np.ndarray, width: int) -> pa.Table:
    """For each guide of whole bins the rows' features after it, before it and overlapping it, as far as its bin holds them.

    Rows stand in order of bin, then features in order of (fs, fe, feature), then guides; a bin begins at each of `starts`.
    A feature after a guide is looked for where the guide ends, and among those that begin in that bin; one before it where
    it begins, and among those that end in that bin. So both belong to one bin each, whatever bins a row is dealt to.
    """
    group = np.zeros(len(rows), np.int64)
    group[starts[starts > 0]] = 1
    group = np.cumsum(group)
    guide, bins, a, b = (np.asarray(rows.column(c)) for c in ("guide", "bin", "a", "b"))
    f, g = np.flatnonzero(~guide), np.flatnonzero(guide)
    base, span = bins * width, width + 2
    key = lambda at, place: group[at] * span + place

    def find(found: np.ndarray, among: np.ndarray, asks: np.ndarray) -> np.ndarray:
        """Rows at `found` among features, and -1 for guides that don't ask or whose bin has no such feature."""
        inside = asks & (found >= 0) & (found < len(among))
        at = among[np.where(inside, found, 0)] if len(among) else np.full(len(found), -1)
        return np.where(inside & (group[at] == group[g]), at, -1)

    here = f[a[f] // width == bins[f]]
    after = find(np.searchsorted(key(here, a[here] - base[here]), key(g, b[g] - base[g])), here, b[g] // width == bins[g])
    here = f[b[f] // width == bins[f]]
    ends = key(here, b[here] - base[here])
    order = np.argsort(ends, kind="stable")  # those that end at one place keep their order
    here, ends = here[order], ends[order]
    last = np.searchsorted(ends, key(g, a[g] - base[g]), side="right") - 1
    first = np.searchsorted(ends, ends[last]) if len(ends) else last
    before = find(np.where(last < 0, -1, first), here, a[g] // width == bins[g])
    here = f[b[f] > a[f]]
    reach = np.maximum.accumulate(key(here, np.clip(b[here] - base[here], 0, width)))  # rises first where a feature ends beyond all earlier ones
    over = find(np.searchsorted(reach, key(g, np.clip(a[g] - base[g], -1, width)), side="right"), here, b[g] > a[g])
    over = np.where((over >= 0) & (a[over] < b[g]), over, -1)
    out = {"id": rows.column("id").take(pa.array(g)), "chrom": rows.column("chrom").take(pa.array(g)), "bin": bins[g], "gs": a[g], "ge": b[g]}
    for side, at in zip(SIDES, (after, before, over)):
        rows_of = pa.array(at, mask=at < 0)
        out |= {f"{side}_fs": rows.column("a").take(rows_of), f"{side}_fe": rows.column("b").take(rows_of), f"{side}_feature": rows.column("feature").take(rows_of)}
    return pa.table(out)


def _bins(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """`_in_bins` of a sorted stream; no more than a bin and a batch is held."""
    held: list[pa.RecordBatch] = []

    def starts_of(rows: pa.Table) -> np.ndarray:
        chrom, bins = np.asarray(rows.column("chrom").combine_chunks().dictionary_encode().indices), np.asarray(rows.column("bin"))
        return np.append(0, np.flatnonzero((chrom[1:] != chrom[:-1]) | (bins[1:] != bins[:-1])) + 1)

    for batch in batches:
        if not len(batch):
            continue
        if held and (held[-1].column("bin")[-1], held[-1].column("chrom")[-1]) == (batch.column("bin")[-1], batch.column("chrom")[-1]):
            held.append(batch)  # one bin still
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        starts = starts_of(rows)
        if starts[-1]:
            yield from _in_bins(rows.slice(0, starts[-1]), starts[:-1], width).to_batches()
        held = rows.slice(starts[-1]).to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield from _in_bins(rows, starts_of(rows), width).to_batches()


def nearest(guides: DataFrame, features: DataFrame, width: int = BIN) -> DataFrame:
    """The nearest feature after each guide, and the nearest that overlaps it or lies before it.

    guides: (chrom, gs, ge, id); features: (chrom, fs, fe, feature) with feature a sortable value; half-open. Strand plays
    no part. Distance: 0 for an overlap, fs - ge + 1 for a feature after, -(gs - fe + 1) for one before. "downstream" is
    the least positive distance, or what "upstream" finds if there is none; "upstream" is the first overlapping feature
    in order of (fs, fe, feature), or else the one that ends last before the guide. A direction without any feature has
    no row. Result: (id, direction, feature, fs, fe, distance).

    Guides and features are dealt by bin once, sorted there and read as a stream, so no task holds a chromosome. What
    lies beyond a guide's bin comes from a table of one row per bin, the bin's first start and last end, carried over
    empty bins.
    """
    bin_of = lambda c: F.expr(f"cast(floor({c} / {width}) as long)")
    value = F.struct("fs", "fe", "feature")
    f = features.select("chrom", F.col("fs").cast("long").alias("fs"), F.col("fe").cast("long").alias("fe"), "feature")
    g = guides.select("chrom", F.col("gs").cast("long").alias("gs"), F.col("ge").cast("long").alias("ge"), "id")
    f = f.withColumn("bin", F.explode(F.sequence(F.least(bin_of("fs"), bin_of("fe")), F.greatest(bin_of("fs"), bin_of("fe")))))
    g = g.withColumn("bin", F.explode(F.sequence(F.least(bin_of("gs"), bin_of("ge")), F.greatest(bin_of("gs"), bin_of("ge")))))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = f.select("chrom", "bin", F.lit(False).alias("guide"), F.col("fs").alias("a"), F.col("fe").alias("b"), "feature", none(g, "id"))
    both = both.unionByName(g.select("chrom", "bin", F.lit(True).alias("guide"), F.col("gs").alias("a"), F.col("ge").alias("b"), none(f, "feature"), "id"))
    both = both.repartition("chrom", "bin").sortWithinPartitions("chrom", "bin", "guide", "a", "b", "feature")
    kinds = {"id": g.schema["id"].dataType, "chrom": g.schema["chrom"].dataType} | dict.fromkeys(("bin", "gs", "ge"), LongType())
    for side in SIDES:
        kinds |= {f"{side}_fs": LongType(), f"{side}_fe": LongType(), f"{side}_feature": f.schema["feature"].dataType}
    x = both.mapInArrow(lambda batches: _bins(batches, width), StructType([StructField(*k) for k in kinds.items()]))
    x = x.select("id", "chrom", "bin", "gs", "ge", *[F.when(F.col(f"{s}_fs").isNotNull(), F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("fs", "fe", "feature")])).alias(s) for s in SIDES])
    start = F.min(F.when(F.col("bin") == bin_of("fs"), value))
    end = F.min(F.when(F.col("bin") == bin_of("fe"), F.struct((-F.col("fe")).alias("back"), value.alias("value"))))
    edges = f.groupBy("chrom", "bin").agg(start.alias("start"), end["value"].alias("end"))
    bins = edges.unionByName(g.select("chrom", "bin").distinct(), allowMissingColumns=True).groupBy("chrom", "bin").agg(F.max("start").alias("start"), F.max("end").alias("end"))
    carried = lambda c, side: F.last(c, ignorenulls=True).over(Window.partitionBy("chrom").orderBy(side).rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select("chrom", "bin", carried("start", F.desc("bin")).alias("next"), carried("end", F.asc("bin")).alias("last"))
    x = x.join(bins, ["chrom", "bin"])
    x = x.withColumn("after", F.when(F.col("bin") == bin_of("ge"), F.coalesce("after", "next"))).withColumn("before", F.when(F.col("bin") == bin_of("gs"), F.coalesce("before", "last")))
    x = x.groupBy("id").agg(*[F.min(c).alias(c) for c in ("gs", "ge", *SIDES)])
    up = F.coalesce("over", "before")
    down = F.coalesce(F.col("after"), up)
    x = x.withColumn("hit", F.explode(F.array(F.struct(F.lit("downstream").alias("direction"), down.alias("value")), F.struct(F.lit("upstream").alias("direction"), up.alias("value")))))
    x = x.select("id", "gs", "ge", "hit.direction", "hit.value.*").where("fs is not null")
    kind = lambda c: F.col(c).cast(features.schema[c].dataType).alias(c)
    return x.select("id", "direction", "feature", kind("fs"), kind("fe"), distance().cast(features.schema["fs"].dataType).alias("distance"))


def distance() -> Column:
    return F.when(F.col("fs") >= F.col("ge"), F.col("fs") - F.col("ge") + 1).when(F.col("fe") <= F.col("gs"), -(F.col("gs") - F.col("fe") + 1)).otherwise(0)


def near_start(before: int, into: int, stranded: bool = False) -> Column:
    """Whether a guide lies within `before` bases before a feature's start or `into` bases into it (both exclusive).

    Columns gs, ge, gstrand, fs, fe, fstrand, distance. By default a guide on the feature's strand counts as before it if
    it stands left of it, whatever the strand; with `stranded`, left of a forward and right of a reverse feature.
    """
    gs, ge, fs, fe, d = (F.col(c) for c in ("gs", "ge", "fs", "fe", "distance"))
    same = F.col("gstrand") == F.col("fstrand")
    forward = F.col("fstrand") == "+"
    ahead = (d > 0) & (d < before)
    if stranded:
        ahead = F.when(forward, ahead).otherwise((d < 0) & (-d < before))
    inside = (d == 0) & F.when(forward, ge - fs < into).otherwise(fe - gs < into)
    within = lambda x, most: (x > 0) & (x < most)
    opposite = F.when(forward, within(fs - ge, before) | within(ge - fs, into)).otherwise(within(gs - fe, before) | within(fe - gs, into))
    return F.when(same, ahead | inside).otherwise(opposite)
