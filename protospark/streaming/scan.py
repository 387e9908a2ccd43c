"""The scan over a stream of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import Pam, find_targets
from ..operators.targets import flag_restriction_sites, seed


def stream_targets(sequences: DataFrame, pam: Pam, length: int = 20, lsr: int = 10, sites: tuple[str, ...] = (), event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Guides of a stream of (record_idx, seqid, seq), each seed once: the first to come.

    The scan and the site flag hold no state. Seeds are kept in state to drop repeats; with `event_time` (a column of
    sequences that is then carried along) a watermark lets state older than `delay` go.
    """
    found = flag_restriction_sites(find_targets(sequences, pam, length, carry=(event_time,) if event_time else ()), list(sites)).withColumn("seedseq", seed(F.col("target"), lsr, pam.orientation))
    if event_time is None:
        return found.dropDuplicates(["seedseq"])
    return found.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["seedseq"])
