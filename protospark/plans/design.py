"""The guide design: from sequences and features to the guide table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import gc_fraction
from ..operators import intervals, neighbors, scan, scores, targets


@dataclass(frozen=True)
class Options:
    """Parameters of a design, checked as the command line checks them."""

    pam: str = "NGG"
    orientation: str = "3prime"
    length: int = 20
    lsr: int = 10
    dtype: str = "hamming"
    dist: int = 2
    before: int = 100
    into: int = 200
    knum: int = 5
    controls: int = 1000
    enzymes: tuple[str, ...] = ()
    drop_sites: bool = False
    strict_seeds: bool = False
    stranded: bool = False
    attribute_key: str = "locus_tag"
    attributes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        rules = {
            "length is 10 to 27": 10 <= self.length <= 27,
            "lsr is 0 to 27 and not over the guide's length": 0 <= self.lsr <= min(27, self.length),
            "the motif has 2 to 8 letters": 2 <= len(self.pam) <= 8,
            "dist is 0 to 5": 0 <= self.dist <= 5,
            "before is 1 to 500": 1 <= self.before <= 500,
            "into is 1 to 500": 1 <= self.into <= 500,
            "knum is 2 to 20": 2 <= self.knum <= 20,
            "controls is 0 to 100000": 0 <= self.controls <= 100_000,
            "orientation is 3prime or 5prime": self.orientation in ("3prime", "5prime"),
        }
        if broken := [rule for rule, held in rules.items() if not held]:
            raise ValueError("; ".join(broken))


_kept: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """Keep what several branches of a plan read, in memory or else on disk; what a lost executor held is computed again.

    `release` lets go of all that was kept, once the tables made from it are written.
    """
    _kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _kept[-1]


def release() -> None:
    while _kept:
        _kept.pop().unpersist()


def flagged_targets(sequences: DataFrame, o: Options) -> DataFrame:
    """Scanned guides with restriction and seed flags. The scan is kept: flags, neighbors and features all read it."""
    found = held(scan.find_targets(sequences, scan.Pam(o.pam, o.orientation, o.dtype), o.length))
    found = targets.flag_restriction_sites(found, list(o.enzymes))
    if o.drop_sites:
        found = targets.drop_restriction_sites(found)
    return targets.flag_seeds(found, o.lsr, o.orientation, o.strict_seeds).withColumn("dtype", F.lit(o.dtype))


def unique_targets(sequences: DataFrame, o: Options) -> DataFrame:
    """Those of `flagged_targets` whose seed is not a repeat. Only they are kept, not the scan, which may be many times larger than its input."""
    return held(_unique(scan.find_targets(sequences, scan.Pam(o.pam, o.orientation, o.dtype), o.length), o))


def _unique(found: DataFrame, o: Options) -> DataFrame:
    found = targets.flag_restriction_sites(found, list(o.enzymes))
    if o.drop_sites:
        found = targets.drop_restriction_sites(found)
    return targets.first_of_seeds(found, o.lsr, o.orientation, o.strict_seeds).withColumn("dtype", F.lit(o.dtype))


def guide_key() -> Column:
    """A guide's place, which is unique: record, strand and start. Records of one name are told apart by record_idx."""
    return F.struct("record_idx", "seqid", "start", "strand")


def attached(found: DataFrame, features: DataFrame, o: Options) -> DataFrame:
    """Seed-unique guides with the features near whose start they lie: at most one row for each direction."""
    unique = held(found.where("not isseedduplicated").withColumn("id", guide_key()))
    places = unique.select(F.col("seqid").alias("chrom"), F.col("start").alias("gs"), F.col("stop").alias("ge"), "id")
    f = features.select("chrom", "fs", "fe", F.struct("feature", "fstrand").alias("feature"))
    near = intervals.nearest(places, f).select("id", "direction", F.col("feature.feature").alias("feature"), F.col("feature.fstrand").alias("fstrand"), "fs", "fe", "distance")
    x = unique.join(near, "id").withColumns({"gs": F.col("start"), "ge": F.col("stop"), "gstrand": F.when(F.col("strand"), "+").otherwise("-")})
    return x.where(intervals.near_start(o.before, o.into, o.stranded)).drop("id")


def nearby(found: DataFrame, features: DataFrame) -> DataFrame:
    """Every seed-unique guide with its nearest feature in each direction, unfiltered."""
    unique = found.where("not isseedduplicated").withColumn("id", guide_key())
    places = unique.select(F.col("seqid").alias("chrom"), F.col("start").alias("gs"), F.col("stop").alias("ge"), "id")
    return unique.select("id", "target").join(intervals.nearest(places, features.select("chrom", "fs", "fe", "feature")), "id")


def guide_table(sequences: DataFrame, features: DataFrame, qualifiers: DataFrame | None, o: Options, weights: dict[str, float] | None = None, model: str | None = None, scored: bool = False) -> DataFrame:
    """The guide table: guides near feature starts that are far from every other guide, with their neighbors and qualifiers.

    qualifiers: a row per "Feature id". Guides are looked up among all distinct targets of the genome; only those that lie
    near a feature's start are asked for, which is the smaller side of the search.
    """
    found = scan.find_targets(sequences, scan.Pam(o.pam, o.orientation, o.dtype), o.length)
    if o.drop_sites:
        found = targets.drop_restriction_sites(targets.flag_restriction_sites(found, list(o.enzymes)))
    rows = held(attached(unique_targets(sequences, o), features, o))
    pool = held(found.select("target").distinct())  # counted first, then dealt
    lists = neighbors.keep_distant(neighbors.neighbor_lists(neighbors.knn(rows.where("length(target_seq30) = 30"), pool, o.knum, o.dtype)), o.dist)
    if weights is not None:
        lists = scores.cfd_scores(lists, weights)
    x = rows.join(lists, "target").where(F.length("target_seq30") == 30)
    out = x.select(
        F.md5("target").alias("Guide name"),
        F.col("target").alias("Guide sequence"),
        gc_fraction(F.col("target")).alias("GC"),
        "dtype",
        F.col("seqid").alias("Accession"),
        (F.col("start") + 1).alias("Guide start"),
        F.col("stop").alias("Guide end"),
        F.col("gstrand").alias("Guide strand"),
        F.col("exact_pam").alias("PAM"),
        F.col("feature").alias("Feature id"),
        (F.col("fs") + 1).alias("Feature start"),
        F.col("fe").alias("Feature end"),
        F.col("fstrand").alias("Feature strand"),
        F.col("distance").alias("Feature distance"),
        F.col("neighbors.seq").alias("Similar guides"),
        F.col("neighbors.dist").alias("Similar guide distances"),
        "target_seq30",
        *([F.col("`CFD Similar Guides`"), F.col("`Max CFD`")] if weights is not None else []),
    )
    if qualifiers is not None:
        out = out.join(qualifiers, "Feature id", "left")
    if o.attributes:
        if o.attribute_key not in out.columns:
            raise ValueError(f"no attribute {o.attribute_key!r}; there are {', '.join(out.columns)}")
        out = out.where(F.col(f"`{o.attribute_key}`").isin(*o.attributes))
    if scored:
        out = scores.on_target_scores(out, model, pam=o.pam, orientation=o.orientation, length=o.length).drop("target_seq30")
    return out


def strand_label() -> Column:
    """Whether a guide of the guide table stands on its feature's coding strand."""
    return F.when(F.col("Guide strand") == F.col("Feature strand"), "coding").otherwise("non-coding")
