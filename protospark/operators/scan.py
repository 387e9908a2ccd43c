"""Scan of both strands for a degenerate motif."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import CODES, COMPLEMENTS, IUPAC, check_motif, reverse_complement_text

#: Bases of a block, besides its margins: the unit that is dealt out.
BLOCK = 1 << 16
#: Bases that are searched at a time.
AT_ONCE = 1 << 20
#: The long context that on-target scores read: three bases outside the motif, 27 with it.
CONTEXT, OUTSIDE = 30, 3


@dataclass(frozen=True)
class Pam:
    """A motif, the side of the guide it stands on, and the distance measure of its guides."""

    pam: str
    orientation: str = "3prime"
    dtype: str = "hamming"

    def __post_init__(self) -> None:
        object.__setattr__(self, "pam", check_motif(self.pam))
        if self.orientation not in ("3prime", "5prime"):
            raise ValueError(f"orientation is 3prime or 5prime, not {self.orientation!r}")


def blocks(sequences: DataFrame, margin: int, width: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """Cut sequences into rows (record_idx, seqid, n, core, first, block): bases [first, ...) around the core's `width` bases.

    Blocks are cut from bytes, so a cut costs its own length only, and are dealt out over the cluster: a genome's file may
    be one partition, and the scan costs more than moving its bases. Each cut is made inside the generator: what a
    projection before a generator computes may be computed again for every row that the generator makes.
    """
    x = sequences.select("record_idx", "seqid", F.octet_length("seq").alias("n"), F.encode("seq", "UTF-8").alias("raw"), *carry)

    def cut(core: Column) -> Column:
        first = F.greatest(F.lit(0), core - margin)
        return F.struct(core.alias("core"), first.alias("first"), F.substring("raw", first + 1, core - first + width + margin).alias("block"))

    cuts = F.transform(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1, F.lit(width))), cut)
    x = x.select("record_idx", "seqid", "n", F.explode(cuts).alias("b"), *carry).select("record_idx", "seqid", "n", "b.*", *carry)
    return x if x.isStreaming else x.repartition("record_idx", "core")


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text or binary column, put together, and where each row's begin and the last one's end."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return text, bounds - bounds[0]


def fixed_texts(text: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    """Text column of a matrix of bytes, a row each; null where not `known`."""
    rows, width = text.shape
    valid = None if known is None else pa.py_buffer(np.packbits(known, bitorder="little"))
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(np.arange(rows + 1, dtype=np.int64) * width), pa.py_buffer(np.ascontiguousarray(text)), valid).cast(pa.string())


def table_of(chars: str, values: str) -> np.ndarray:
    """What each byte turns into: capitals of letters, N for what is no ASCII, and values for chars."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("a") : ord("z") + 1] -= 32
    out[128:] = ord("N")
    out[list(chars.encode())] = list(values.encode())
    return out


CAPITALS, PARTNERS = table_of("", ""), table_of(CODES, COMPLEMENTS)
#: A bit for each of the four bases, none for other letters.
BITS = np.zeros(256, np.uint8)
BITS[list(b"ACGT")] = 1, 2, 4, 8


def places(bits: np.ndarray, motif: str) -> np.ndarray:
    """0-based places of all matches of a motif, overlapping ones too, in bases given as bits."""
    size = max(0, len(bits) - len(motif) + 1)
    found = np.ones(size, bool)
    for i, c in enumerate(motif):
        found &= bits[i : i + size] & np.bitwise_or.reduce(BITS[list(IUPAC[c].encode())]) != 0
    return np.flatnonzero(found)


def _hits(part: pa.RecordBatch, pam: Pam, length: int, width: int, carry: tuple[str, ...]) -> list[pa.RecordBatch]:
    """Guides of some blocks, a batch for each strand."""
    raw, bounds = texts_of(part.column("block"))
    text = CAPITALS[raw]
    bits = BITS[text]
    n, core, first = (np.asarray(part.column(c)).astype(np.int64) for c in ("n", "core", "first"))
    bad = np.append(0, np.cumsum(bits == 0)) if not bits.all() else None
    text = np.append(text, np.zeros(CONTEXT, np.uint8))  # so that there is a window at every base
    p, three, out = len(pam.pam), pam.orientation == "3prime", []
    for motif, ahead in ((pam.pam, True), (reverse_complement_text(pam.pam), False)):
        at = places(bits, motif)
        row = np.searchsorted(bounds, at, side="right") - 1
        s = at - bounds[row] + first[row]
        after = ahead != three  # the guide stands after the motif on the forward strand
        start = s + p if after else s - length
        # the context takes OUTSIDE bases beyond the motif's far side
        from30 = s - OUTSIDE if after else s + p - (CONTEXT - OUTSIDE)
        keep = (s >= core[row]) & (s < core[row] + width) & (at + p <= bounds[row + 1]) & (start >= 0) & (start + length <= n[row])
        at, row, s, start, from30 = (x[keep] for x in (at, row, s, start, from30))
        if bad is not None:
            first_base = at + start - s
            clean = bad[first_base + length] == bad[first_base]
            at, row, s, start, from30 = (x[clean] for x in (at, row, s, start, from30))
        fits = (from30 >= 0) & (from30 + CONTEXT <= n[row])

        def cut(begin: np.ndarray, size: int) -> np.ndarray:
            found = np.lib.stride_tricks.sliding_window_view(text, size)[begin]
            return found if ahead else PARTNERS[found[:, ::-1]]

        rows = pa.array(row)
        known = {
            "record_idx": part.column("record_idx").take(rows),
            "seqid": part.column("seqid").take(rows),
            "target": fixed_texts(cut(at + start - s, length)),
            "exact_pam": fixed_texts(cut(at, p)),
            "start": pa.array(start.astype(np.int32)),
            "stop": pa.array((start + length).astype(np.int32)),
            "strand": pa.array(np.full(len(at), ahead)),
            "pam_orientation": pa.array(np.full(len(at), not three)),
            "target_seq30": fixed_texts(cut(np.where(fits, at + from30 - s, 0), CONTEXT), fits),
        }
        out.append(pa.RecordBatch.from_pydict(known | {c: part.column(c).take(rows) for c in carry}))
    return out


def find_targets(sequences: DataFrame, pam: Pam, length: int = 20, width: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every guide of `length` bases next to a motif, overlapping ones too, on both strands.

    sequences: (record_idx, seqid, seq). Result: (record_idx, seqid, target, exact_pam, start, stop, strand,
    pam_orientation, target_seq30), coordinates 0-based half-open on the forward strand, strand true for forward.
    A guide must lie in its record and hold A, C, G, T only; a context that doesn't fit is null. A record without
    hits gives no row, and no hit at all an empty table. `carry` names columns of sequences to take along.
    """
    x = blocks(sequences, length + CONTEXT + len(pam.pam), width, carry)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.append(0, np.cumsum(np.asarray(pc.binary_length(batch.column("block")))))
            a = 0
            while a < len(batch):  # rows of about AT_ONCE bases
                b = max(a + 1, int(np.searchsorted(size, size[a] + AT_ONCE, side="right")) - 1)
                yield from _hits(batch.slice(a, b - a), pam, length, width, carry)
                a = b

    kinds = {c: x.schema[c].dataType.simpleString() for c in ("record_idx", "seqid", *carry)}
    kind = lambda c: f"`{c}` {kinds[c]}"
    schema = ", ".join([kind("record_idx"), kind("seqid"), "target string, exact_pam string, start int, stop int, strand boolean, pam_orientation boolean, target_seq30 string", *map(kind, carry)])
    return x.mapInArrow(find, schema)
