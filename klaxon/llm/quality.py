"""Quality by Bradley-Terry ranking: from pairs of a preferred and a rejected document, the weights of a linear score are learned by
logistic loss on the differences of their features; a quantile of the scores is the threshold.

Features come from the whole text alone: counts that describe its surface (SURFACE), and its content as shares of hashed words and of hashed
runs of four bytes (HASHED of each), whose weights are held smaller. Learning takes at most MOST_LABELLED labelled documents (those of
lowest hash) and MOST_PAIRS pairs of them. The threshold is the quantile of those documents' scores that leaves below it the share
of them that was rejected; the score is a logistic curve of the distance from the threshold, whose slope is fitted as well, and is CUT
at the threshold.

Defined results: a null or empty text has the features of an empty one and a score like others; a very long text is read whole; equal texts tie,
with equal scores, and repeated rows are scored each; null ids count as not held out and teach nothing; labels that are null teach
nothing; without labels of both kinds every weight is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_of, slices, text_or_empty

MOST_LABELLED, MOST_PAIRS, FOLDS, CUT = 20_000, 200_000, 5, 0.3
#: Places for hashed words, and as many for hashed runs of bytes. Ridge of the weights of each kind of feature.
HASHED, RIDGE_SURFACE, RIDGE_CONTENT = 512, 1e-3, 3e-1

#: Bytes of each kind; those from 128 on are parts of letters.
_kinds = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "high": [*range(192, 256)],
    "digit": [*range(48, 58)],
    "stop": [46, 44],
    "loud": [33, 63],
    "bar": [124],
    "symbol": [35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 126, 95, 92],
    "line": [10],
}
SURFACE = [*_kinds, "chars", "words", "word_length", "word_spread", "distinct", "top", "again", "pair_again", "lines_again", "short_line", "long_word", "closed"]


_word_places: dict[str, int] = {}


def _word_place(word: str) -> int:
    found = _word_places.get(word)
    if found is None:
        found = zlib.crc32(word.encode()) % HASHED
        if len(_word_places) < 300_000:
            _word_places[word] = found
    return found


def content(text: str, words: list[str]) -> np.ndarray:
    """Roots of the shares of the text's words, and of its runs of four bytes, in each hashed place."""
    out = np.zeros(2 * HASHED, np.float32)
    if words:
        out[:HASHED] = np.bincount(np.fromiter(map(_word_place, words), np.int64, len(words)), minlength=HASHED) / len(words)
    data = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if len(data) > 3:
        runs = (data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)) * np.uint32(0x9E3779B1)
        out[HASHED:] = np.bincount(runs >> np.uint32(32 - HASHED.bit_length() + 1), minlength=HASHED) / len(runs)
    return np.sqrt(out)


def features(text: str) -> np.ndarray:
    """SURFACE, then content()."""
    low = text.lower()
    return np.concatenate([np.array(surface(text), np.float32), content(low, low.split())])


def surface(text: str) -> list[float]:
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(data, minlength=256)
    n = max(1, len(data))
    words = text.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    tally = Counter(words)
    top = max(tally.values(), default=0)
    lines = text.split("\n")
    share = [counts[k].sum() / n for k in _kinds.values()]
    return [
        *(math.sqrt(x) for x in share),
        math.log1p(len(data)) / 10,
        math.log1p(len(words)) / 10,
        float(lengths.mean()) / 10,
        float(lengths.std()) / 10,
        math.log1p(len(tally)) / max(1.0, math.log1p(len(words))),
        math.sqrt(top / m),
        math.sqrt(sum(map(eq, words, words[1:])) / m),
        math.sqrt(sum(map(eq, words, words[2:])) / m),
        math.sqrt(1 - len(set(lines)) / len(lines)),
        math.sqrt(sum(len(x) < 20 for x in lines) / len(lines)),
        math.sqrt(float((lengths > 20).sum()) / m),
        math.sqrt(sum(w[-1] in ".,;:" for w in words) / m),
    ]


@dataclass
class Ranker:
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        return np.array([1 / (1 + math.exp(-min(30.0, max(-30.0, float(features(t or "") @ self.weights) + self.bias)))) for t in texts])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pair_loss(w: np.ndarray, z: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient, weight of each pair in the second derivative) of the pairs' logistic loss with a ridge."""
    s = z @ w.astype(z.dtype)
    d = (s[better] - s[worse]).astype(np.float64)
    p = _sigmoid(-d)
    n = len(d)
    by_row = (np.bincount(worse, p, len(z)) - np.bincount(better, p, len(z))) / n
    return float(np.logaddexp(0, -d).mean() + 0.5 * (ridge * w * w).sum()), z.T @ by_row.astype(z.dtype) + ridge * w, p * (1 - p) / n


def rank(x: np.ndarray, y: np.ndarray, pairs: int = MOST_PAIRS, seed: int = 11, overwrite: bool = False) -> Ranker:
    """Newton's method on the pairs' logistic loss, its steps by conjugate gradients: what is held is a row for each document, and
    never one for each pair. The scale of each feature is divided out first, in x itself if it may be overwritten."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    width = len(SURFACE) + 2 * HASHED
    if not len(good) or not len(bad):
        return Ranker(np.zeros(width), math.log(CUT / (1 - CUT)))
    rng = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    better, worse = rng.choice(good, n), rng.choice(bad, n)
    mean = x.mean(0)
    scale = np.maximum(np.concatenate([x[:, k : k + 64].std(0) for k in range(0, width, 64)]), 1e-6)  # by columns, so that no other array of x's size is made
    z = x if overwrite else x.copy()
    z -= mean
    z /= scale
    ridge = np.repeat([RIDGE_SURFACE, RIDGE_CONTENT], [len(SURFACE), width - len(SURFACE)])
    w = np.zeros(width)
    for _ in range(30):
        loss, gradient, curve = pair_loss(w, z, better, worse, ridge)

        def bend(v: np.ndarray) -> np.ndarray:
            s = z @ v.astype(z.dtype)
            c = curve * (s[better] - s[worse])  # noqa: B023
            return z.T @ (np.bincount(better, c, len(z)) - np.bincount(worse, c, len(z))).astype(z.dtype) + ridge * v

        step, left = np.zeros(width), -gradient
        towards, size = left.copy(), float(left @ left)
        for _ in range(60):
            bent = bend(towards)
            a = size / max(float(towards @ bent), 1e-30)
            step, left = step + a * towards, left - a * bent
            size, before = float(left @ left), size
            if size < 1e-4 * float(gradient @ gradient):
                break
            towards = left + size / before * towards
        length = 1.0
        while (after := pair_loss(w + length * step, z, better, worse, ridge)[0]) > loss and length > 1e-3:
            length /= 2
        if after > loss:
            break
        w = w + length * step
        if loss - after < 1e-7 * loss:
            break
    s = (z @ w.astype(z.dtype)).astype(np.float64)
    at = float(np.quantile(s, len(bad) / len(s)))
    # The slope is that of a logistic curve through CUT at the threshold.
    base, slope = math.log(CUT / (1 - CUT)), 1.0
    for _ in range(50):
        t = s - at
        p = _sigmoid(slope * t + base)
        step_ = (t @ (y - p) - 1e-3 * slope) / ((t * t * p * (1 - p)).sum() + 1e-3)
        slope = float(np.clip(slope + np.clip(step_, -1, 1), 0.05, 50))
    weights = slope * w / scale
    return Ranker(weights, base - slope * at - float(mean @ weights))


def keep_good(docs: DataFrame, ranker: Ranker, cut: float = CUT) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least `cut`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(ranker.score(part.column("text").to_pylist()) >= cut))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, pairs: int = MOST_PAIRS) -> Ranker:
    """Learned from the labelled documents that are not held out. Features are worked out for the sample alone."""
    known = labels.where("quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    known = sample_of(known.join(texts.select("doc_id"), "doc_id", "left_semi"), "doc_id", most)  # only ids are dealt out for this
    rows = texts.join(F.broadcast(known), "doc_id").withColumn("tie", F.xxhash64("text"))  # `most` rows of ids and labels
    rows = rows.join(F.broadcast(rows.select("doc_id", "quality", "tie").orderBy("doc_id", "quality", "tie").limit(most).distinct()), ["doc_id", "quality", "tie"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = [features(t).astype(np.float16).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array(x, pa.binary())], ["quality", "x"])

    found = rows.select(F.col("quality").cast("int").alias("quality"), "text").mapInArrow(run, "quality int, x binary").orderBy("quality", "x").limit(most)
    # The driver holds one row of single precision for each sampled document, and no list or second copy of them.
    x, y = np.empty((most, len(SURFACE) + 2 * HASHED), np.float32), []
    for r in found.toLocalIterator():
        x[len(y)] = np.frombuffer(r["x"], np.float16)
        y.append(r["quality"])
    return rank(x[: len(y)], np.array(y, np.float64), pairs, overwrite=True)


def score_documents(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    ranker = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ranker.score(part.column("text").to_pylist()))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
