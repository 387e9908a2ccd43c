"""Language identification by nearest centroid over TF-IDF vectors of letter n-grams."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

#: Hashed n-gram dimensions (2**BITS), documents vectorised at a time, bytes of a text read at a time.
BITS, BLOCK, CHUNK = 12, 256, 1 << 20
#: Anything ASCII but a lower-case letter counts as a space.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
UNKNOWN = "und"
#: Lengths, in powers of two, for which each language has a radius.
LENGTHS = 8
#: Texts and stretches by which a radius is set, at least.
MANY = 300


def grams(text: str | None) -> np.ndarray:
    """Counts of the hashed byte trigrams of a whole text in lower case, without those around a space."""
    counts = np.zeros(1 << BITS, np.float32)
    data = np.frombuffer((text or "").lower().encode().translate(LETTERS), np.uint8)
    for at in range(0, max(0, len(data) - 2), CHUNK):
        a = data[at : at + CHUNK + 2].astype(np.uint32)
        a = a[:-2] << 16 | a[1:-1] << 8 | a[2:] if len(a) > 2 else a[:0]
        a = a[a >> 8 & 255 != 32]
        counts += np.bincount((a * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return counts


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def sizes(counts: np.ndarray) -> np.ndarray:
    """The binary logarithm of each row's n-grams, whole, from 0 to LENGTHS; a row without any counts as having one."""
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1), 1)).astype(int), LENGTHS)


def parts(text: str) -> list[str]:
    """A text and stretches of it of 4, 8, 16, ... characters, at places that its hash sets."""
    out, h = [text], zlib.crc32(text.encode())
    for b in range(2, LENGTHS):
        if 2**b >= len(text):
            break
        at = (h * (2 * b + 1)) % (len(text) - 2**b + 1)
        out.append(text[at : at + 2**b])
    return out


@dataclass
class Model:
    """Centroids with their languages; `idf` weighs the dimensions; radius[k, b] is the least cosine of language k for texts
    of 2**b to 2**(b + 1) - 1 n-grams."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cosine to the nearest centroid and rejection of each text."""
        n = len(texts)
        langs, score, cosine = [UNKNOWN] * n, np.zeros(n), np.zeros(n)
        rejected = np.ones(n, bool)
        for at in range(0, n, BLOCK):
            rows = [i for i in range(at, min(n, at + BLOCK)) if has_letter(texts[i])]
            if not rows or not self.langs:
                continue
            counts = np.stack([grams(texts[i]) for i in rows])
            near = self.vectors(counts) @ self.centroids.T
            best = np.stack([near[:, self.owner == k].max(axis=1) for k in range(len(self.langs))], axis=1).astype(np.float64)
            top = best.argmax(axis=1)
            odds = np.exp(25 * (best - best.max(axis=1, keepdims=True)))
            score[rows] = 1 / odds.sum(axis=1)
            cosine[rows] = best[np.arange(len(rows)), top]
            rejected[rows] = cosine[rows] < self.radius[top, sizes(counts)]
            for i, k in zip(rows, top):
                langs[i] = self.langs[k]
        return langs, np.clip(score, 0, 1), cosine, rejected


Sparse = tuple[np.ndarray, np.ndarray]


def fit(sample: list[tuple[str, list[Sparse]]], clusters: int = 4, slack: float = 0.75, rounds: int = 12, low: float = 1) -> Model:
    """Spherical k-means within each language, and its rejection radii.

    sample: rows of (language, sparse counts of a whole text and of stretches of it). The centroids come from whole texts. A
    radius is `slack` times the `low` percentile of the cosines that the sample's texts and stretches of that length have,
    or what a neighbouring length has more rows to say: lengths with few rows are put together with longer ones. So one
    rule holds at all lengths: what lies farther out than the language's own texts of its length do is rejected. Rows
    without any n-gram teach nothing. A centroid that less than `low` percent of a language's rows are nearest to goes:
    a few rows of another language under this label would make that language known.
    """
    sample = [(lang, c) for lang, c in sample if len(c[0][0])]
    langs = sorted({lang for lang, _ in sample})
    none = np.zeros((len(langs), LENGTHS + 1))
    if not langs:
        return Model([], np.zeros(1 << BITS, np.float32), np.zeros((0, 1 << BITS), np.float32), np.zeros(0, int), none)
    counts = np.zeros((len(sample), 1 << BITS), np.float32)
    for row, (_, c) in zip(counts, sample):
        row[c[0][0]] = c[0][1]
    idf = (np.log((1 + len(sample)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Model(langs, idf, np.zeros((0, 1 << BITS), np.float32), np.zeros(0, int), none)
    v, lang = model.vectors(counts).astype(np.float32), np.array([langs.index(x) for x, _ in sample])
    centroids, owner = [], []
    for k in range(len(langs)):
        own = v[lang == k]
        c = own[[0]]
        while len(c) < min(clusters, len(own)):  # the row farthest from all centroids so far
            c = np.vstack([c, own[(own @ c.T).max(axis=1).argmin()]])
        for _ in range(rounds):
            at = (own @ c.T).argmax(axis=1)
            c = np.stack([own[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        c = c[np.bincount((own @ c.T).argmax(axis=1), minlength=len(c)) >= low / 100 * len(own)]
        centroids.append(c)
        owner += [k] * len(c)
        near, size = [], []
        for at, n in (stretch for x, row in sample if x == langs[k] for stretch in row if len(stretch[0])):
            w = np.log1p(n) * idf[at]
            near.append(float((c[:, at] @ w).max() / np.linalg.norm(w)))
            size.append(min(int(np.log2(n.sum())), LENGTHS))
        near, size = np.array(near), np.array(size)
        for b in range(LENGTHS + 1):
            at = size == b
            wide = b
            while at.sum() < min(MANY, len(size)) and wide < LENGTHS:  # longer ones too, then shorter ones
                wide += 1
                at |= size == wide
            wide = b
            while at.sum() < min(MANY, len(size)):
                wide -= 1
                at |= size == wide
            model.radius[k, b] = slack * np.percentile(near[at], low)
    model.centroids, model.owner = np.vstack(centroids).astype(np.float32), np.array(owner)
    return model


def train(docs: DataFrame, per_lang: int = 600, total: int = 6000, key: str = "doc_id", text: str = "text", lang: str = "lang", seed: int = 3) -> Model:
    """Fit on a sample of labelled rows of about `per_lang` a language, or `total` over all if there are many languages.

    Rows are drawn by a hash of key and text, and equal rows teach once, so reruns agree and a repeated key brings no flood.
    The `total` / 2 most frequent languages are learned; a language beyond them gets no row, and its texts are judged by
    their distance to the others. Executors turn each sampled text, read whole, and stretches of it into sparse counts
    of 2**BITS dimensions at most; only those go to the driver. Rows with null text or language, or a text without an
    n-gram, teach nothing.
    """
    drawn = F.xxhash64(F.lit(seed), key, text)
    rows = docs.select(drawn.alias("drawn"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counted = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(total // 2).collect()}
    each = min(per_lang, total // max(1, len(counted)))
    chosen = [F.when(F.col("lang") == k, F.pmod("drawn", F.lit(1 << 30)) < int((1 << 30) * each / n)) for k, n in counted.items()]

    @F.arrow_udf("array<struct<at: array<int>, n: array<float>>>")
    def sparse(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            every = [grams(t) for t in parts(x.as_py())]
            out.append([{"at": np.flatnonzero(c).astype(np.int32), "n": c[c > 0]} for c in every])
        return pa.array(out, pa.list_(pa.struct([("at", pa.list_(pa.int32())), ("n", pa.list_(pa.float32()))])))

    sample = []
    if chosen:
        found = rows.where(F.coalesce(*chosen)).dropDuplicates(["drawn", "lang"]).select("lang", "drawn", sparse("text").alias("c")).toArrow()
        for k, d, c in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), found.column(2)):
            every = zip(c.values.field(0), c.values.field(1))
            sample.append((k, d, [(at.values.to_numpy(), n.values.to_numpy()) for at, n in every]))
    sample.sort(key=lambda x: x[:2])
    return fit([(k, cs) for k, _, cs in sample])


def identify(model: Model, text: Column) -> Column:
    """Struct (lang, score, cosine, rejected) of a whole text.

    A text that is null or has no letter is `und` with score 0 and rejected; any other gets the language of the nearest
    centroid by cosine, and is rejected if that cosine is under the language's radius for its length. A text with letters
    but no n-gram ("q") is as near to every language, cosine 0: it gets the first by name and is judged like texts of one
    n-gram. Score is the nearest language's share of exp(25 * cosine). A model without languages (an empty table) calls
    every text `und` and rejects it.
    """

    @F.arrow_udf("struct<lang: string, score: double, cosine: double, rejected: boolean>")
    def run(texts: pa.Array) -> pa.Array:
        langs, score, cosine, rejected = model.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score), pa.array(cosine), pa.array(rejected)], ["lang", "score", "cosine", "rejected"])

    return run.asNondeterministic()(text)


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text is not rejected."""
    judged = spread(docs).select(F.struct("*").alias("row"), identify(model, F.col(text)).alias("found"))
    return judged.where("not found.rejected").select("row.*")
