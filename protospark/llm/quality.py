"""Quality rules: document statistics, base rules, and gradient-boosted trees over the statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
WINDOW = 8
#: Words whose windows are hashed at a time (a longer text is taken alone).
BATCH_WORDS = 1 << 19
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks"]
#: Features, and how the quality score may move as each rises (0: either way).
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "distinct": 0, "upper": -1, "digits": 0, "marks": -1}
FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated(docs: list[list[bytes]]) -> np.ndarray:
    """Per text, how many words lie in windows of WINDOW words found twice or more in that text.

    Windows of all texts are hashed together and sorted; only those whose hash meets again are compared word by word,
    so the counts are exact.
    """
    lens = np.array([len(w) for w in docs], np.int64)
    out, ends = np.zeros(len(docs), np.int64), np.cumsum(lens)
    total = int(lens.sum())
    if total < WINDOW:
        return out
    h = np.fromiter(map(hash, chain.from_iterable(docs)), np.int64, total).view(np.uint64)
    n = total - WINDOW + 1
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key += (h[k : k + n] ^ h[k : k + n] >> np.uint64(29)) * FACTORS[k]
    owner = np.repeat(np.arange(len(docs)), lens)
    inside = owner[:n] == owner[WINDOW - 1 :]
    key ^= owner[:n].astype(np.uint64) * FACTORS[0] ^ key >> np.uint64(31)
    key, at = key[inside], np.flatnonzero(inside)
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return out
    again = np.unique(again)
    spot = np.minimum(np.searchsorted(again, key), len(again) - 1)
    at = at[again[spot] == key]
    for d in np.unique(owner[at]):
        words, base = docs[d], int(ends[d] - lens[d])
        places = (at[owner[at] == d] if len(docs) > 1 else at) - base
        windows = [tuple(words[i : i + WINDOW]) for i in places.tolist()]
        seen = Counter(windows)
        edge = np.zeros(len(words) + 1, np.int64)
        for i, w in zip(places.tolist(), windows):
            if seen[w] > 1:
                edge[i] += 1
                edge[i + WINDOW] -= 1
        out[d] = int((np.cumsum(edge) > 0).sum())
    return out


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATS for each whole text; a null text counts as empty."""
    out = np.zeros((len(texts), len(STATS)), np.int64)
    points = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    held: list[list[bytes]] = []
    first = pending = 0

    def count(upto: int) -> None:
        nonlocal held, pending, first
        out[first:upto, 4] = repeated(held)
        held, pending, first = [], 0, upto

    for i, x in enumerate(texts.cast(pa.binary())):
        b = x.as_py() or b""
        words, lines = b.split(), [y for y in b.split(b"\n") if y.strip(SPACE)]
        less = lambda chars: len(b) - len(b.translate(None, chars))  # noqa: B023, E731
        out[i] = [len(words), points[i] - less(SPACE), less(SYMBOLS), len(lines) - len(set(lines)), 0, len(lines), len(set(words)), less(UPPER), less(DIGITS), less(b"!?")]
        if pending + len(words) > BATCH_WORDS and held:
            count(i)
        held.append(words)
        pending += len(words)
    count(len(texts))
    return out


def features(stats: np.ndarray) -> np.ndarray:
    s = dict(zip(STATS, stats.astype(np.float64).T))
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.stack([np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / words, s["n_distinct"] / words, s["n_upper"] / chars, s["n_digits"] / chars, s["n_marks"] / words], axis=1)


@dataclass
class Trees:
    """Complete trees of one depth as node arrays (tree, node): go right where the feature exceeds the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality of each row, all rows and trees walked together a level at a time."""
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        at, t = np.zeros((len(x), trees), np.int64), np.arange(trees)
        while inner:
            f = self.feature[t, at]
            at = 2 * at + 1 + (np.take_along_axis(x, f, axis=1) > self.threshold[t, at])
            inner >>= 1
        return 1 / (1 + np.exp(-(self.base + self.value[t, at - self.feature.shape[1]].sum(axis=1))))


def boost(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss over histograms of quantile bins.

    A split on a feature with a monotonic constraint must order its children's values that way, and its subtrees
    inherit the middle of the two as a bound, so the whole score is monotonic in the feature.
    """
    rows, width = x.shape
    inner = (1 << depth) - 1
    p = np.clip(y.mean() if rows else 1.0, 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    model = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if not rows or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1)
    raw, grown = np.full(rows, base), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = q - y, q * (1 - q)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node, low, high = np.zeros(rows, np.int64), np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for k in range(inner):
            inside = node == k
            best = (1e-6, 0, 0, 0.0, 0.0)
            for j in range(width):
                gs = np.bincount(code[inside, j], g[inside], bins)[: len(edges[j])].cumsum()
                hs = np.bincount(code[inside, j], h[inside], bins)[: len(edges[j])].cumsum()
                gt, ht = g[inside].sum(), h[inside].sum()
                left, right = np.clip(-gs / (hs + ridge), low[k], high[k]), np.clip(-(gt - gs) / (ht - hs + ridge), low[k], high[k])
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least) | (monotone[j] * (right - left) < 0)] = 0
                if len(gain) and gain.max() > best[0]:
                    c = int(gain.argmax())
                    best = (gain[c], j, c, left[c], right[c])
            for side in (1, 2):
                low[2 * k + side], high[2 * k + side] = low[k], high[k]
            if best[0] > 1e-6:
                _, j, c, left, right = best
                feature[k], threshold[k] = j, edges[j][c]
                if monotone[j]:
                    (high if monotone[j] > 0 else low)[2 * k + 1] = (left + right) / 2
                    (low if monotone[j] > 0 else high)[2 * k + 2] = (left + right) / 2
                node = np.where(inside, 2 * k + 1 + (code[:, j] > c), node)
            else:
                node = np.where(inside, 2 * k + 1, node)
        leaf = node - inner
        gl, hl = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = rate * np.clip(-gl / (hl + ridge), low[inner:], high[inner:])
        raw += value[leaf]
        grown.append((feature, threshold, value))
    return Trees(*(np.stack(a) for a in zip(*grown)), base)


def measured(text: Column) -> Column:
    """Struct of STATS of a whole text."""

    @F.arrow_udf(f"struct<{', '.join(f'{s}: long' for s in STATS)}>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c) for c in statistics(texts).T], STATS)

    return run.asNondeterministic()(text)


def train(docs: DataFrame, labels: DataFrame, rows: int = 6000, key: str = "doc_id", text: str = "text", label: str = "quality", seed: int = 5) -> Trees:
    """Fit on a sample of about `rows` labelled documents, drawn by a hash of their key.

    Only the sample's keys are broadcast (their number is the parameter) and only its statistics reach the driver.
    Labels that are null teach nothing; a key with several counts once, as the least, and a key with several documents
    by one of them. Without labels, or with labels
    of one kind, the model accepts everything that the base rules accept.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
    n = max(1, known.count())
    known = known.where(F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / n)))
    sample = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(known), "_key")
    # a key that many rows have brings one of them
    once = sample.groupBy("_key", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("one"))
    found = once.select("_key", "_label", measured(F.col("one._text")).alias("s")).collect()
    found.sort(key=lambda r: (r["_key"], tuple(r["s"])))
    stats = np.array([tuple(r["s"]) for r in found], np.int64).reshape(-1, len(STATS))
    return boost(features(stats), np.array([float(r["_label"] > 0) for r in found]), list(FEATURES.values()))


def judge(model: Trees, text: Column, least: float = 0.3) -> Column:
    """Struct of STATS with base_failed, score and kept, of a whole text.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. kept: not base_failed, and the trees'
    score is `least` or more (under one half, so that doubtful documents stay). A null text counts as empty and fails.
    """

    @F.arrow_udf(f"struct<{', '.join(f'{s}: long' for s in STATS)}, base_failed: boolean, score: double, kept: boolean>")
    def run(texts: pa.Array) -> pa.Array:
        s = statistics(texts)
        failed = (s[:, 0] < 20) | (100 * s[:, 4] > 30 * s[:, 0])
        score = model.score(features(s))
        return pa.StructArray.from_arrays([pa.array(c) for c in (*s.T, failed, score, ~failed & (score >= least))], [*STATS, "base_failed", "score", "kept"])

    return run.asNondeterministic()(text)


def keep_good(docs: DataFrame, model: Trees, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that are kept."""
    judged = spread(docs).select(F.struct("*").alias("row"), judge(model, F.col(text), least).alias("found"))
    return judged.where("found.kept").select("row.*")
