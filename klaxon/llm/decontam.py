"""Benchmark decontamination by latent semantic retrieval. The benchmark's words are the terms; all passages of the corpus give their
document frequencies and, in one more pass, the sketch of a randomised SVD of their TF-IDF matrix. Windows of every document are
projected on its leading directions and compared with the items' segments by cosine; what is near enough is checked by the weighted
longest common subsequence of words, and weaker matches by whether the item's answer (its last sentence) is there too.

The SVD: A holds a row for each passage of PASSAGE words. Each task sums A'(A W) over its passages for one random matrix W (terms by
RANK + 16), and as A'A is positive, the Nystrom formula turns the sum into A's right singular vectors without another pass. How near
is near enough comes from simulated leaks, for all items together and for each on its own, and the lower holds: windows of it with a fifth of the words replaced and moved by up to
a half stride must pass with the probability RECALL, whether the other words are no terms, any terms or terms as frequent as in the
corpus. Every word of the benchmark is a term however common it is, as a widely leaked item
makes its own words common; the idf has a floor above 0.

What is accepted in the end holds WITH_ANSWER of an item's weight in order, so its place holds that much in any order: sums of weights over
steps of 8 words, cheap for all items at once, show where that can be. Windows are projected there and nowhere else, which loses
nothing. Terms, frequencies, the SVD and the thresholds are fitted once, for all items; the search then takes items
in blocks of ITEM_BLOCK, whose size changes what a task holds but not what is found. The driver holds the benchmark's words, and a task
also the directions of all terms (a benchmark's distinct words, 256 bytes for each).

Defined results: null or empty texts hold no leak, and null or wordless items match nothing; a very long text is searched whole; an item of
fewer than SHORT words, which any text may hold by chance, leaks only where it is a document's whole text, word for word; items that tie (equal texts) are found each; null ids are kept; repeated rows each give
their rows, and a document gives a row for each item that it holds (the best place); an empty corpus or benchmark gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, slices, text_or_empty
from .components import run_groups

PASSAGE, RANK, ITEM_BLOCK = 32, 64, 2_000
#: Steps of 8 words in a passage.
STEPS = PASSAGE // 8
#: Windows for items from so many words on; the first is for shorter ones too.
WINDOWS, SHORT = (12, 24), 6
#: Least share of an item's words in order; least weighted share, alone and with its answer.
WORDS, ALONE, WITH_ANSWER, RECALL = 0.4, 0.6, 0.45, 0.99
#: Simulated leaks of each item and kind of other words.
SIMULATED = 100

_word = re.compile(r"\w+")
#: Each character of Latin-1 as itself if words have it, else as a space.
_WORDS = bytes(k if _word.match(chr(k)) else 32 for k in range(256))
_sentence = re.compile(r"[.!?](?:\s|$)|\n")
RESULT = "doc_id long, text_key long, item_id long, cosine double, share double, answer boolean, word_from long, word_to long"
_result = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("share", pa.float64()), ("answer", pa.bool_()), ("word_from", pa.int64()), ("word_to", pa.int64())])


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


@dataclass
class Items:
    ids: list[int | None]
    tokens: list[np.ndarray]  # of each item, its terms in order
    answers: list[np.ndarray]
    terms: dict[str, int]

    def part(self, begin: int, end: int) -> Items:
        return Items(self.ids[begin:end], self.tokens[begin:end], self.answers[begin:end], self.terms)


def read_items(rows: Iterable) -> Items:
    terms: dict[str, int] = {}
    ids, tokens, answers = [], [], []
    for item_id, text in rows:
        own = [terms.setdefault(w, len(terms)) for w in words_of(text or "")]
        if own:
            last = [words_of(s) for s in _sentence.split(text)]
            last = [s for s in last if s][-1]
            ids.append(item_id)
            tokens.append(np.array(own, np.int32))
            answers.append(np.array([terms.setdefault(w, len(terms)) for w in last], np.int32))
    return Items(ids, tokens, answers, terms)


def tokenise(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """doc_id, text_key, tokens: for each word of the text its term, or -1."""
    kind = "<i2" if len(terms) < 32_000 else "<i4"
    of_bytes = {w.encode("latin-1"): n for w, n in terms.items() if max(w) < "\u0100"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text in part.column("text").to_pylist():
                    try:  # the words of words_of(), cut as bytes
                        words, known = text.lower().encode("latin-1").translate(_WORDS).split(), of_bytes
                    except UnicodeEncodeError:
                        words, known = words_of(text), terms
                    out.append(np.fromiter(map(known.get, words, repeat(-1)), kind, len(words)).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(out, pa.binary())], ["doc_id", "text_key", "tokens"])

    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, tokens binary")


def _flat(tokens: list[bytes], kind: str, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens in one array, each text filled up with -2 to a multiple of `pad`, with one run of it at least; and where texts begin."""
    arrays = [np.frombuffer(t, kind) for t in tokens]
    rooms = [(len(a) // pad + 1) * pad for a in arrays]
    starts = np.concatenate([[0], np.cumsum(rooms)]).astype(np.int64)
    flat = np.full(int(starts[-1]), -2, np.int32)
    for a, s in zip(arrays, starts.tolist()[:-1], strict=True):
        flat[s : s + len(a)] = a
    return flat, starts


def _passages(flat: np.ndarray) -> np.ndarray:
    rows = flat.reshape(-1, PASSAGE)
    return rows[rows[:, 0] != -2]


def document_frequency(tokens: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and all passages."""
    kind = "<i2" if n_terms < 32_000 else "<i4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "tokens", 1 << 20):
                rows = np.sort(_passages(_flat(part.column("tokens").to_pylist(), kind, PASSAGE)[0]), axis=1)
                new = rows >= 0
                new[:, 1:] &= rows[:, 1:] != rows[:, :-1]
                df[:-1] += np.bincount(rows[new], minlength=n_terms)
                df[-1] += len(rows)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["term", "n"])

    out = np.zeros(n_terms + 1, np.int64)
    for r in tokens.select("tokens").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


def weigh(df: np.ndarray, n: int) -> np.ndarray:
    """idf of terms, at last of words that are none and of fillings, so that -1 and -2 index them."""
    idf = np.maximum(np.log((n + 1) / (df + 1)), 0.1)
    return np.concatenate([idf, [0.0, idf.mean()]]).astype(np.float32)


_sums = pa.schema([("block", pa.int64()), ("sum", pa.binary())])


def latent_directions(tokens: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """(terms, rank): the leading right singular vectors of the passages' TF-IDF matrix."""
    n_terms, wide, block = len(idf) - 2, min(rank + 16, max(1, len(idf) - 2)), 1024
    kind = "<i2" if n_terms < 32_000 else "<i4"
    omega = np.random.default_rng(seed).standard_normal((n_terms, wide)).astype(np.float32)
    weighted = np.concatenate([omega * idf[:-2, None], np.zeros((2, wide), np.float32)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_terms, wide))
        for batch in batches:
            for part in slices(batch, "tokens", 256 << 10):
                rows = _passages(_flat(part.column("tokens").to_pylist(), kind, PASSAGE)[0])
                seen = _project_sums(rows, weighted) / (idf[rows] ** 2).sum(1)[:, None]  # A W, each row over its length once more
                term = rows.ravel().astype(np.int16 if n_terms < 32_000 else np.int32)
                order = np.argsort(term, kind="stable")
                order = order[np.searchsorted(term[order], 0) :]
                if not len(order):
                    continue
                term = term[order]
                first = np.flatnonzero(np.diff(term, prepend=-1))
                total[term[first]] += np.add.reduceat(seen[order // PASSAGE], first, axis=0) * idf[term[first], None]
        for k in range(0, n_terms, block):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([total[k : k + block].tobytes()], pa.binary())], ["block", "sum"])

    def add(group: list[dict]) -> list[tuple]:
        total = sum(np.frombuffer(r["sum"]) for r in group)
        return [(group[0]["block"], total.tobytes())]

    parts = tokens.select("tokens").mapInArrow(run, "block long, sum binary")
    # Sums of sums, so that no task adds up what all tasks gave.
    halfway = run_groups(parts.withColumn("deal", F.pmod(F.xxhash64("sum"), F.lit(32))), ["block", "deal"], add, "block long, sum binary", _sums)
    y = np.zeros((n_terms, wide))
    for r in run_groups(halfway, ["block"], add, "block long, sum binary", _sums).collect():
        y[r["block"] : r["block"] + block] = np.frombuffer(r["sum"]).reshape(-1, wide)
    core = omega.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * max(values.max(), 1e-30)
    u, _, _ = np.linalg.svd(y @ vectors[:, good] / np.sqrt(values[good]), full_matrices=False)
    return u[:, :rank].astype(np.float32)


@dataclass
class Segments:
    """What windows of one width are compared with."""

    width: int
    vectors: np.ndarray  # (segments, rank), of length 1
    item: np.ndarray
    offset: np.ndarray
    cosine: np.ndarray  # what windows must reach


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-9)


def _project_sums(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    z = np.zeros((len(rows), table.shape[1]), np.float32)
    for column in rows.T:
        z += table[column]
    return z


def _project_held(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The sums of the terms alone (table has no other rows): each row's come first, rows with most of them first, so that a column of them is a run."""
    held = rows >= 0
    many = held.sum(1)
    order = np.argsort(-many, kind="stable")
    terms = np.take_along_axis(rows, np.argsort(~held, axis=1, kind="stable"), axis=1)[order]
    z = np.zeros((len(rows), table.shape[1]), np.float32)
    for k, n in enumerate(np.searchsorted(-many[order], -np.arange(rows.shape[1])).tolist()):
        z[:n] += table[terms[:n, k]]
    out = np.empty_like(z)
    out[order] = z
    return out


def _project(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Unit latent vectors of rows of tokens; table: the terms' weighted directions, and zeros for -2 and -1."""
    return _unit(_project_sums(rows, table))


def _windows(flat: np.ndarray, width: int, table: np.ndarray) -> np.ndarray:
    """Unit latent vectors of the windows of so many tokens, one from each quarter of a window on; the quarters are summed once."""
    stride = width // 4
    n = len(flat) // stride
    parts = _project_sums(flat[: n * stride].reshape(n, stride), table)
    return _unit(parts[: n - 3] + parts[1 : n - 2] + parts[2 : n - 1] + parts[3:])


def _kind_of(length: int) -> list[int]:
    """The places in WINDOWS of the widths that search for an item of so many words."""
    return [k for k, width in enumerate(WINDOWS) if (length >= width or k == 0 and length >= SHORT) and (k + 1 == len(WINDOWS) or length < WINDOWS[k + 1])]


def _segments_of(words: np.ndarray, width: int, table: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(unit vectors, offsets) of the windows of an item."""
    offsets = sorted({*range(0, max(1, len(words) - width + 1), width // 2), max(0, len(words) - width)})
    rows = [np.pad(words[at : at + width], (0, max(0, width - len(words))), constant_values=-2) for at in offsets]
    return _project(np.stack(rows), table), offsets


_simulated = pa.schema([("item", pa.int64()), ("kind", pa.int64()), ("draw", pa.int64()), ("best", pa.list_(pa.float32()))])


def least_cosines(spark: SparkSession, items: Items, idf: np.ndarray, table: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """For each width, what windows must reach for each item (nan where the width doesn't search for it): simulated leaks, other text around
    an item, a fifth of its words replaced, seen from the window that fits best. Items are simulated by Spark's tasks, each from a seed of
    its own."""
    n_terms = len(idf) - 2
    common = np.cumsum(np.exp(-idf[:-2].astype(np.float64)))
    tokens = items.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                rng, t = np.random.default_rng([seed, i]), tokens[i]
                others = (lambda n: np.full(n, -1), lambda n: rng.integers(0, n_terms, n), lambda n: np.searchsorted(common, rng.random(n) * common[-1]))  # noqa: B023
                for k in _kind_of(len(t)):
                    width, stride = WINDOWS[k], WINDOWS[k] // 4
                    own, _ = _segments_of(t, width, table)
                    quarters = (2 * width + len(t)) // stride + 2
                    at = width + rng.integers(0, stride, (SIMULATED, 1)) + np.arange(len(t))
                    for draw, other in enumerate(others):
                        lines = other((SIMULATED, quarters * stride))
                        line, word = np.nonzero(rng.random((SIMULATED, len(t))) >= 0.2)
                        lines[line, at[line, word]] = t[word]
                        near = (_windows(lines.ravel(), width, table) @ own.T).max(1)
                        best = np.maximum.reduceat(near, np.arange(SIMULATED) * quarters)
                        yield pa.RecordBatch.from_pylist([{"item": i, "kind": k, "draw": draw, "best": best.tolist()}], schema=_simulated)

    parts = max(1, min(len(tokens), spark.sparkContext.defaultParallelism * 4))
    found = save(spark.range(0, len(tokens), 1, parts).mapInArrow(run, "item long, kind long, draw long, best array<float>"), "simulated")
    out = [np.full(len(tokens), np.nan, np.float32) for _ in WINDOWS]
    each = found.select("item", "kind", "draw", F.explode("best").alias("best"))
    low = F.percentile("best", F.lit(1 - RECALL))
    for r in each.groupBy("item", "kind", "draw").agg(low.alias("low")).groupBy("item", "kind").agg(F.min("low").alias("low")).collect():  # a row or two for each item
        out[r["kind"]][r["item"]] = r["low"]
    # What all items' leaks reach together holds for each item too, so that one that stands out is no harder to find.
    for r in each.groupBy("kind", "draw").agg(low.alias("low")).groupBy("kind").agg(F.min("low").alias("low")).collect():
        out[r["kind"]] = np.minimum(out[r["kind"]], np.float32(r["low"]))
    return out


def segment(items: Items, cosines: list[np.ndarray], table: np.ndarray) -> list[Segments]:
    out = []
    for k, width in enumerate(WINDOWS):
        mine = [(i, *_segments_of(t, width, table)) for i, t in enumerate(items.tokens) if k in _kind_of(len(t))]
        if mine:
            owner = np.repeat([i for i, _, _ in mine], [len(offsets) for *_, offsets in mine])
            out.append(Segments(width, np.concatenate([v for _, v, _ in mine]), owner, np.array([x for *_, offsets in mine for x in offsets]), cosines[k][owner]))
    return out


def _in_order(item: np.ndarray, place: np.ndarray, idf: np.ndarray) -> float:
    """The weighted share of the item's words that stand in the same order in `place`."""
    best = np.zeros(len(place) + 1)
    for t in item.tolist():
        take = np.where(place == t, best[:-1] + idf[t], 0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], take))
    return float(best[-1] / idf[item].sum())


def _count_in_order(item_masks: dict[int, int], n: int, place: list[int]) -> int:
    """The length of the longest common subsequence, by bits of one integer (Hyyro, 2004)."""
    full = (1 << n) - 1
    v = full
    for t in place:
        u = v & item_masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _stands_in(needle: np.ndarray, place: np.ndarray) -> bool:
    n = len(needle)
    return n <= len(place) and any((place[k : k + n] == needle).all() for k in np.flatnonzero(place[: len(place) - n + 1] == needle[0]))


def search(tokens: DataFrame, items: Items, cosines: list[np.ndarray], idf: np.ndarray, table: np.ndarray) -> DataFrame:
    """The leaks of the items; cosines as least_cosines() gives them for these."""
    n_terms = len(idf) - 2
    kind = "<i2" if n_terms < 32_000 else "<i4"
    kinds = segment(items, cosines, table)
    masks = []
    for t in items.tokens:
        m: dict[int, int] = {}
        for k, x in enumerate(t.tolist()):
            m[x] = m.get(x, 0) | 1 << k
        masks.append(m)
    short: dict[tuple[int, ...], list[int]] = {}
    for i, t in enumerate(items.tokens):
        if len(t) < SHORT:
            short.setdefault(tuple(t.tolist()), []).append(i)

    sizes = np.array([len(t) for t in items.tokens])
    slacks = np.maximum(4, sizes // 4)

    needs = WITH_ANSWER * np.array([idf[t].sum(dtype=np.float64) for t in items.tokens]) * (1 - 1e-5)
    # Which terms an item has: by item as item * n_terms + term, and by term.
    has = np.unique(np.concatenate([np.unique(t).astype(np.int64) + i * n_terms for i, t in enumerate(items.tokens)]))
    having, of_term = np.divmod(has, n_terms)
    # Items whose places reach equally many steps back and ahead are bounded together, so they get columns side by side.
    reach_back, reach_ahead = (slacks + 7) // 8, 1 + (sizes + slacks + 7) // 8
    item_of = np.lexsort((reach_ahead, reach_back))
    column_of = np.argsort(item_of)
    by_term = np.argsort(of_term, kind="stable")
    columns, first_of_term = column_of[having[by_term]], np.searchsorted(of_term[by_term], np.arange(n_terms + 1))
    pad = int(sizes.max(initial=0)) // 8 + 2
    front, tail = pad + int(reach_back.max(initial=0)), int(reach_ahead.max(initial=0))
    # The same in passages, rounded up.
    far, far_back, far_ahead = -(-pad // STEPS), -(-int(reach_back.max(initial=0)) // STEPS), (tail + STEPS - 2) // STEPS + 1

    def weights_before(flat: np.ndarray, begin: int, end: int) -> np.ndarray:
        """(front + steps of 8 words + tail + 1, columns from begin to end): the weight of each item's words, in any order, before each step."""
        n = len(flat) // 8
        at = np.flatnonzero(flat >= 0)
        t = flat[at]
        many = first_of_term[t + 1] - first_of_term[t]
        ends = np.cumsum(many)
        column = columns[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first_of_term[t] - ends + many, many)]
        key, weight = np.repeat(at // 8, many) * (end - begin) + column - begin, np.repeat(idf[t], many)
        if end - begin < len(items.ids):
            mine = (column >= begin) & (column < end)
            key, weight = key[mine], weight[mine]
        out = np.zeros((front + n + tail + 1, end - begin))
        out[front + 1 : front + 1 + n] = np.bincount(key, weight, n * (end - begin)).reshape(n, end - begin)
        return np.cumsum(out, axis=0, out=out)

    def plausible(flat: np.ndarray, i: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which places hold enough of their item's words, in any order."""
        out = np.zeros(len(i), bool)
        span = np.arange(int((hi - lo).max(initial=1)))
        rows = max(1, 1_000_000 // len(span))
        for k in range(0, len(i), rows):
            own, at = i[k : k + rows, None], lo[k : k + rows, None] + span
            t = np.where(at < hi[k : k + rows, None], flat[np.minimum(at, len(flat) - 1)], -2).astype(np.int64)
            sought = own * n_terms + t
            held = (t >= 0) & (has[np.minimum(np.searchsorted(has, sought), len(has) - 1)] == sought)
            own = own[:, 0]
            out[k : k + rows] = (held.sum(1) >= WORDS * sizes[own]) & ((idf[t] * held).sum(1, dtype=np.float64) >= needs[own])
        return out

    def reaches(k: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(first column, end, steps back, steps ahead) of runs of columns whose items reach equally far."""
        while k < end:
            back, ahead, first = int(reach_back[item_of[k]]), int(reach_ahead[item_of[k]]), k
            while k < end and reach_back[item_of[k]] == back and reach_ahead[item_of[k]] == ahead:
                k += 1
            yield first, k, back, ahead

    def open_passages(flat: np.ndarray) -> np.ndarray:
        """Which passages, from -far on, hold a step from which whole passages hold enough of any item: a bound of the bounds by steps, from
        a quarter of their sums."""
        whole = len(flat) // PASSAGE
        rows, at = whole + far, front - far
        out = np.zeros(rows, bool)
        wide = max(1, 4_000_000 // max(rows, n_terms))
        for begin in range(0, len(items.ids), wide):
            end = min(begin + wide, len(items.ids))
            weight, mine = np.zeros((n_terms, end - begin), np.float32), (columns >= begin) & (columns < end)
            weight[of_term[by_term][mine], columns[mine] - begin] = idf[of_term[by_term][mine]]
            before = np.zeros((front + whole + tail + 1, end - begin))
            before[front + 1 : front + 1 + whole] = _project_held(flat.reshape(-1, PASSAGE), weight)
            np.cumsum(before, axis=0, out=before)
            for first, last, back, ahead in reaches(begin, end):
                mine, back, ahead = slice(first - begin, last - begin), -(-back // STEPS), (ahead + STEPS - 2) // STEPS + 1
                held = before[at + ahead : at + ahead + rows, mine] - before[at - back : at - back + rows, mine]
                out |= (held >= needs[item_of[first:last]]).any(axis=1)
        return out

    def bounded(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(step, item) of all places, whatever their words' order, whose surrounding whole steps hold enough of the item; sorted by both.
        A place may begin before the first word."""
        whole, open_ = len(flat) // PASSAGE, np.flatnonzero(open_passages(flat)) - far
        # Steps are summed in open passages and in what their places reach, side by side; sums across a gap belong to no open passage.
        edges = np.bincount(np.clip(open_ - far_back, 0, whole), minlength=whole + 1) - np.bincount(np.clip(open_ + far_ahead, 0, whole), minlength=whole + 1)
        kept = np.flatnonzero(np.cumsum(edges)[:whole] > 0)
        if not len(kept):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat = flat.reshape(-1, PASSAGE)[kept].ravel()
        rows = len(flat) // 8 + pad
        found: list[tuple[np.ndarray, np.ndarray]] = []
        wide = max(1, 4_000_000 // (len(flat) // 8 + 1))
        for begin in range(0, len(items.ids), wide):
            end = min(begin + wide, len(items.ids))
            before, at = weights_before(flat, begin, end), front - pad
            for first, last, back, ahead in reaches(begin, end):
                mine = slice(first - begin, last - begin)
                held = before[at + ahead : at + ahead + rows, mine] - before[at - back : at - back + rows, mine]
                step, column = np.divmod(np.flatnonzero(held >= needs[item_of[first:last]]), last - first)
                found.append((step - pad, item_of[first + column]))
        step, i = map(np.concatenate, zip(*found, strict=True))
        step = np.where(step < 0, step + STEPS * kept[0], STEPS * kept[np.maximum(step, 0) // STEPS] + step % STEPS)
        mine = np.isin(step // STEPS, open_)
        step, i = step[mine], i[mine]
        order = np.lexsort((i, step))
        return step[order], i[order]

    def candidates(flat: np.ndarray, starts: np.ndarray) -> dict[tuple[int, int, int], float]:
        """(text, item, where it would begin, in steps) -> cosine."""
        near_step, near_item = bounded(flat)
        if not len(near_step):
            return {}
        open_ = (near_step + pad) * len(items.ids) + near_item  # sorted
        found: list[tuple[np.ndarray, ...]] = []
        for s in kinds:
            # The windows that lie in such places.
            stride = s.width // 4
            searched = np.zeros(len(items.ids), bool)
            searched[s.item] = True
            mine = searched[near_item]
            first = np.clip(near_step[mine] * 8, 0, len(flat)) // stride
            last = np.clip(near_step[mine] * 8 + 8 + sizes[near_item[mine]], 0, len(flat)) // stride + 1
            edges = np.bincount(first, minlength=len(flat) // stride + 2) - np.bincount(last, minlength=len(flat) // stride + 2)
            window = np.flatnonzero(np.cumsum(edges) > 0)
            window = window[window * stride < len(flat)]
            longer = np.concatenate([flat, np.full(s.width, -2, flat.dtype)])
            for k in range(0, len(window), 4096):
                at = window[k : k + 4096] * stride
                near = _project(longer[at[:, None] + np.arange(s.width)], table) @ s.vectors.T
                x, y = np.divmod(np.flatnonzero(near >= s.cosine), near.shape[1])
                step, i = (at[x] - s.offset[y]) // 8, s.item[y]
                key = (step + pad) * len(items.ids) + i
                keep = open_[np.minimum(np.searchsorted(open_, key), len(open_) - 1)] == key
                x, step, i = x[keep], step[keep], i[keep]
                found.append((np.searchsorted(starts, at[x] + s.width // 2, "right") - 1, i, step, near[x, y[keep]]))
        if not found:
            return {}
        text, i, step, cosine = map(np.concatenate, zip(*found, strict=True))
        if not len(step):
            return {}
        text = np.minimum(text, len(starts) - 2)
        low, wide = int(step.min()), int(np.ptp(step)) + 1
        key, place = np.unique((text * len(items.ids) + i) * wide + step - low, return_inverse=True)
        best = np.full(len(key), -1.0, np.float32)
        np.maximum.at(best, place, cosine)
        step, key = key % wide + low, key // wide
        text, i = np.divmod(key, len(items.ids))
        lo, hi = np.maximum(starts[text], step * 8 - slacks[i]), np.minimum(starts[text + 1], step * 8 + 8 + sizes[i] + slacks[i])
        keep = np.flatnonzero(plausible(flat, i, lo, hi))
        return dict(zip(zip(text[keep].tolist(), i[keep].tolist(), step[keep].tolist(), strict=True), best[keep].tolist(), strict=True))

    def check(flat: np.ndarray, starts: np.ndarray, text: int, i: int, begin: int) -> tuple[float, bool, int, int] | None:
        item = items.tokens[i]
        slack = max(4, len(item) // 4)
        lo = max(int(starts[text]), begin - slack)
        hi = min(int(starts[text + 1]), begin + 8 + len(item) + slack)
        place = flat[lo:hi]
        if _count_in_order(masks[i], len(item), place.tolist()) < WORDS * len(item):
            return None
        share = _in_order(item, place, idf)
        answer = len(items.answers[i]) >= 3 and _stands_in(items.answers[i], place)
        if share >= ALONE or share >= WITH_ANSWER and answer:
            return share, answer, lo - int(starts[text]), lo - int(starts[text]) + int((place != -2).sum())
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "tokens", max(16 << 10, min(256 << 10, (50 << 20) // len(items.ids)))):
                tokens_ = part.column("tokens").to_pylist()
                flat, starts = _flat(tokens_, kind, PASSAGE)
                best: dict[tuple[int, int], tuple] = {}
                for (text, i, step), cosine in candidates(flat, starts).items():
                    if (ok := check(flat, starts, text, i, step * 8)) and ok[0] > best.get((text, i), (0, 0))[1]:
                        best[text, i] = (cosine, *ok)
                for text, data in enumerate(tokens_):
                    words = np.frombuffer(data, kind)
                    if len(words) < SHORT:
                        for i in short.get(tuple(words.tolist()), ()):
                            best[text, i] = (1.0, 1.0, True, 0, len(words))
                if best:
                    ids, keys = part.column("doc_id").to_pylist(), part.column("text_key").to_pylist()
                    rows = [(ids[text], keys[text], items.ids[i], *found) for (text, i), found in best.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _result, strict=True)], _result.names)

    return tokens.mapInArrow(run, RESULT)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), item_id, cosine, share (weighted, of the item in order), answer (whether the item's answer
    stands there), word_from, word_to."""
    spark = docs.sparkSession
    items = read_items(benchmark.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator())
    out = spark.createDataFrame([], RESULT)
    if not items.ids:
        return out
    tokens = save(tokenise(docs, items.terms), "tokens")
    idf = weigh(*document_frequency(tokens, len(items.terms)))
    directions = latent_directions(tokens, idf)
    table = np.concatenate([directions * idf[:-2, None], np.zeros((2, directions.shape[1]), np.float32)])
    cosines = least_cosines(spark, items, idf, table)
    for k in range(0, len(items.ids), ITEM_BLOCK):
        out = out.unionByName(search(tokens, items.part(k, k + ITEM_BLOCK), [c[k : k + ITEM_BLOCK] for c in cosines], idf, table))
    return out
