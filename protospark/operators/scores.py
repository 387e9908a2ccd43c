"""Guide scores: off-target products of mismatch weights, features and model of the on-target score."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import fixed_texts, texts_of

#: Letters in the order of the position features, and in that of the NGGX features.
NUCLEOTIDES, NGGX = "ATCG", "ACGT"
PAIRS = ["".join(p) for p in product(NUCLEOTIDES, repeat=2)]
#: Nearest-neighbour enthalpy (kcal/mol) and entropy (cal/mol K) of RNA duplexes, by the first strand's two bases.
STACKS = {
    "AA": (-6.82, -19.0), "TT": (-6.82, -19.0), "AT": (-9.38, -26.7), "TA": (-7.69, -20.5),
    "CA": (-10.44, -26.9), "TG": (-10.44, -26.9), "GT": (-11.40, -29.5), "AC": (-11.40, -29.5),
    "CT": (-10.48, -27.1), "AG": (-10.48, -27.1), "GA": (-12.44, -32.5), "TC": (-12.44, -32.5),
    "CG": (-10.64, -26.7), "GC": (-14.88, -36.9), "GG": (-13.39, -32.7), "CC": (-13.39, -32.7),
}
INITIAL, TERMINAL_AT = (3.61, -1.5), (3.72, 10.5)
#: Parts of the 30-mer whose melting temperatures are features.
SEGMENTS = ((0, 30), (19, 24), (11, 19), (6, 11))
CFD_LENGTH = 20
#: Numbers of a 30-mer that the model of the on-target score reads.
FEATURES = 627


def load_weights(path: str) -> dict[str, float]:
    """Mismatch weights from a JSON file: an object `rX:dY,pos` -> weight, or one that holds it under "mm"."""
    with open(path) as f:
        data = json.load(f)
    return data.get("mm", data)


def rule_weights(steepness: float = 0.045) -> dict[str, float]:
    """Weights by rule, for use without a published table: mismatches cost more towards the motif, transitions less."""
    mild = {("A", "G"), ("G", "A"), ("C", "T"), ("T", "C")}
    comp = dict(zip("ACGT", "TGCA"))
    out = {}
    for pos in range(1, CFD_LENGTH + 1):
        for w, o in product("ACGT", repeat=2):
            if w != o:
                out[f"r{w.replace('T', 'U')}:d{comp[o]},{pos}"] = round(1 - steepness * pos * (0.7 if (w, o) in mild else 1.0), 6)
    return out


def cfd(wt: Column, off: Column, weights: dict[str, float]) -> Column:
    """Product of the weights of the mismatches in the 20 bases next to the motif; shorter guides use the last positions.

    Null for sequences of unequal length; 1 without a mismatch. A mismatch without a weight makes the score null.
    """
    comp = dict(zip("ACGT", "TGCA"))
    short: dict[str, float] = {}
    for key, weight in weights.items():
        rna, rest = key[1:].split(":d")
        dna, pos = rest.split(",")
        short[f"{rna.replace('U', 'T')}{comp[dna.replace('U', 'T')]}{pos}"] = float(weight)
    table = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])
    n = F.length(wt)
    places = F.sequence(F.greatest(F.lit(1), n - CFD_LENGTH + 1), n)
    pair = lambda i: F.concat(F.substring(wt, i, F.lit(1)), F.substring(off, i, F.lit(1)), (i + CFD_LENGTH - n).cast("string"))
    step = lambda acc, i: F.when(F.substring(wt, i, F.lit(1)) == F.substring(off, i, F.lit(1)), acc).otherwise(acc * F.try_element_at(table, pair(i)))
    return F.when((n == F.length(off)) & (n > 0), F.aggregate(places, F.lit(1.0), step))


def cfd_scores(lists: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Add the score of each similar guide, and the highest among those other than the guide itself."""
    scores = F.transform("neighbors", lambda n: cfd(F.col("target"), n["seq"], weights))
    others = F.transform(F.filter("neighbors", lambda n: n["seq"] != F.col("target")), lambda n: cfd(F.col("target"), n["seq"], weights))
    return lists.withColumn("CFD Similar Guides", scores).withColumn("Max CFD", F.array_max(others))


def base_counts(seq: Column) -> list[Column]:
    return [F.length(seq) - F.length(F.replace(seq, F.lit(b), F.lit(""))) for b in NUCLEOTIDES]


#: The place of each letter in NUCLEOTIDES, and one beyond them for all other letters.
PLACE = np.full(256, len(NUCLEOTIDES), np.uint8)
PLACE[list(NUCLEOTIDES.encode())] = range(len(NUCLEOTIDES))


def _by_length(make: Callable[[np.ndarray], np.ndarray], rows: int, width: int, kind: type, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """`make` of the coded letters of all texts of a length at once, put together as (rows, width), and which texts are known."""
    text, bounds = texts_of(column)
    codes, sizes = PLACE[text], np.diff(bounds)
    known = np.asarray(column.is_valid())
    if rows and len(codes) and (sizes == sizes[0]).all():
        return make(codes.reshape(rows, -1)), known
    out = np.zeros((rows, width), kind)
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        out[which] = make(codes[bounds[which][:, None] + np.arange(size)])
    return out, known


def _computed(make: Callable[[np.ndarray], np.ndarray], width: int, kind: type, result: str) -> Callable[[Column], Column]:
    """A function of texts whose values are computed a batch at a time: `make` turns coded letters (a row per text) into
    rows of `width` values. result: array<...> for a row's values, string for them as characters, double for the first
    (null where it is not a number). Null stays null."""

    @F.arrow_udf(result)
    def values(column: pa.Array) -> pa.Array:
        found, known = _by_length(make, len(column), width, kind, column)
        if result == "string":
            return fixed_texts(found, known)
        if result == "double":
            return pa.array(found[:, 0], mask=~known | np.isnan(found[:, 0]))
        return lists_of(found, known)

    return values


def lists_of(values: np.ndarray, known: np.ndarray) -> pa.Array:
    """List column of a matrix, a row each; null where not `known`."""
    rows, width = values.shape
    valid = pa.py_buffer(np.packbits(known, bitorder="little"))
    return pa.ListArray.from_buffers(pa.list_(pa.from_numpy_dtype(values.dtype)), rows, [valid, pa.py_buffer(np.arange(rows + 1, dtype=np.int32) * width)], children=[pa.array(values.ravel())])


def _pairs(codes: np.ndarray) -> np.ndarray:
    """Place in PAIRS of the two-base word at each place, 16 where another letter is in it."""
    a, b = codes[:, :-1], codes[:, 1:]
    return np.where((a < 4) & (b < 4), a * np.uint8(4) + b, np.uint8(16))


def _hot(words: np.ndarray, kinds: int, places: int, one: int = 1, zero: int = 0, kind: type = np.float32) -> np.ndarray:
    """Flat rows of `places` x `kinds` values, one where a place has that kind of word; other and missing words have none."""
    values = np.full((kinds + 1, kinds), zero, kind)
    np.fill_diagonal(values, one)
    if words.shape[1] < places:
        words = np.pad(words, ((0, 0), (0, places - words.shape[1])), constant_values=kinds)
    return values[words[:, :places]].reshape(len(words), places * kinds)


def _counts(words: np.ndarray, kinds: int) -> np.ndarray:
    """How often each kind of word stands in a row; words beyond `kinds` don't count."""
    key = np.arange(len(words))[:, None] * (kinds + 1) + words
    return np.bincount(key.ravel(), minlength=len(words) * (kinds + 1)).reshape(len(words), kinds + 1)[:, :kinds].astype(np.int32)


def pair_counts(seq: Column) -> list[Column]:
    """Overlapping counts of the 16 two-base words."""
    counts = _computed(lambda codes: _counts(_pairs(codes), 16), 16, np.int32, "array<int>")(seq)
    return [F.get(counts, F.lit(i)) for i in range(16)]


def one_hot(seq: Column, order: int, places: int, text: bool = False) -> Column:
    """Flat array, or text: for each place in turn, a 0 or 1 for each base (order 1) or word of two (order 2)."""
    kinds = len(NUCLEOTIDES) ** order
    how = (ord("1"), ord("0"), np.uint8) if text else (1, 0, np.float32)
    return _computed(lambda codes: _hot(codes if order == 1 else _pairs(codes), kinds, places, *how), kinds * places, how[2], "string" if text else "array<float>")(seq)


def gc_count(seq30: Column) -> Column:
    """G and C in the guide's 20 bases of a 30-mer."""
    guide = F.substring(seq30, 5, 20)
    return F.length(guide) - F.length(F.translate(guide, "GC", ""))


def _nggx(codes: np.ndarray) -> np.ndarray:
    """Place in NGGX x NGGX of the base before the motif's GG and the base after it, 16 if there is none."""
    if codes.shape[1] < 28:
        return np.full(len(codes), 16, np.int64)
    turn = np.array([NGGX.index(b) for b in NUCLEOTIDES] + [16])
    a, b = turn[codes[:, 24]], turn[codes[:, 27]]
    return np.where((a < 4) & (b < 4), a * 4 + b, 16)


def nggx(seq30: Column) -> Column:
    """16 zeros and ones: the base before the motif's GG and the base after it."""
    return _computed(lambda codes: _hot(_nggx(codes)[:, None], 16, 1), 16, np.float32, "array<float>")(seq30)


def nggx_place(seq30: Column) -> Column:
    """The place of the one in `nggx`, from 0; null if there is none."""
    a, b = (F.instr(F.lit(NGGX), F.substring(seq30, at, 1)) - 1 for at in (25, 28))
    return F.when(F.length(seq30) >= 28, F.when((a >= 0) & (b >= 0), a * 4 + b))


def _melting(codes: np.ndarray) -> np.ndarray:
    """Melting temperature of each row; not a number with fewer than two bases or another letter."""
    n = codes.shape[1]
    if n < 2:
        return np.full((len(codes), 1), np.nan)
    pairs, at = _pairs(codes), np.isin(codes[:, [0, -1]], [NUCLEOTIDES.index(b) for b in "AT"]).sum(axis=1)
    totals = []
    for k in range(2):
        stacks = np.array([STACKS[p][k] for p in PAIRS] + [np.nan])
        total = INITIAL[k] + at * TERMINAL_AT[k]
        for i in range(n - 1):  # in turn, as a sum of doubles depends on its order
            total = total + stacks[pairs[:, i]]
        totals.append(total)
    entropy = totals[1] + 0.368 * (n - 1) * math.log(0.05)
    return (1000 * totals[0] / (entropy + 1.987 * math.log(12.5e-9)) - 273.15)[:, None]


def melting(seq: Column) -> Column:
    """Nearest-neighbour melting temperature (Celsius) of an RNA duplex, 50 mM salt and 25 nM of each strand."""
    return _computed(_melting, 1, np.float64, "double")(seq)


def _features(codes: np.ndarray) -> np.ndarray:
    """The 627 numbers of 30-mers that hold the four bases only."""
    pairs = _pairs(codes)
    gc = np.isin(codes[:, 4:24], [NUCLEOTIDES.index(b) for b in "GC"]).sum(axis=1)
    parts = [
        _hot(codes, 4, 30),
        _counts(codes, 4),
        _hot(pairs, 16, 29),
        _counts(pairs, 16),
        np.stack([gc > 10, gc < 10, gc], axis=1),
        _hot(_nggx(codes)[:, None], 16, 1),
        *[_melting(codes[:, a:b]) for a, b in SEGMENTS],
    ]
    out, at = np.empty((len(codes), FEATURES), np.float32), 0
    for part in parts:
        out[:, at : at + part.shape[1]] = part
        at += part.shape[1]
    return out


def on_target_features(seq30: Column) -> Column:
    """The 627 numbers of a 30-mer in the model's order; null unless it has 30 bases of ACGT and GG at places 26 and 27."""

    @F.arrow_udf("array<float>")
    def features(column: pa.Array) -> pa.Array:
        text, bounds = texts_of(column)
        fit = np.asarray(column.is_valid()) & (np.diff(bounds) == 30)
        codes = np.zeros((len(column), 30), np.uint8)
        codes[fit] = PLACE[text][bounds[:-1][fit][:, None] + np.arange(30)]
        fit &= (codes < 4).all(axis=1) & (codes[:, 25:27] == NUCLEOTIDES.index("G")).all(axis=1)
        out = np.zeros((len(column), FEATURES), np.float32)
        out[fit] = _features(codes[fit])
        return lists_of(out, fit)

    return features(seq30)


def on_target_scores(table: DataFrame, model: str | None, column: str = "target_seq30", pam: str = "NGG", orientation: str = "3prime", length: int = 20) -> DataFrame:
    """Add `Efficiency` (double) and `efficiency_status`, with an ONNX model that the user supplies, one session a task.

    The score is for 20-base guides with NGG on their 3' side: without a model, with another motif, side or length, or
    for a 30-mer without features it is null, and the status says why.
    """
    x = table.withColumn("_features", on_target_features(F.col(column)))
    unfit = {"motif is not NGG": pam.upper() != "NGG", "motif is not on the 3prime side": orientation != "3prime", "guides do not have 20 bases": length != 20, "no model": model is None}
    if any(unfit.values()):
        why = next(w for w, so in unfit.items() if so)
        return x.drop("_features").withColumn("Efficiency", F.lit(None).cast("double")).withColumn("efficiency_status", F.lit(why))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        for batch in batches:
            rows = [r for r in batch.to_pylist() if r is not None]
            found = iter(session.run(None, {name: np.array(rows, np.float32)})[0].ravel().tolist() if rows else [])
            yield pa.array([next(found) if v.is_valid else None for v in batch], pa.float64())

    x = x.withColumn("Efficiency", score("_features"))
    return x.withColumn("efficiency_status", F.when(F.col("_features").isNull(), "no features").otherwise("scored")).drop("_features")
