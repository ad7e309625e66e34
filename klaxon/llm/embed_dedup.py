"""Embedding near-dedup over an inverted multi-index: two codebooks, one for each half of the unit vectors, form a grid of cells. Every
vector lies in the cell of its two nearest centroids and visits cells in the order of the summed distances of its halves (the order
of the multi-sequence algorithm) until the target recall; what it meets there is verified by cosine in double precision.

The codebooks and the number of visits come from a bounded sample (SAMPLE vectors, or 16 for each centroid if that is more); every vector
is indexed. The number of centroids grows with the root of the largest label's size, so a cell's size doesn't grow. The number of
visits is the one at which a vector turned to just the threshold, in a random direction, is met with probability `target`.

A target of 1 asks for the exact way: a vector visits every cell that can hold a link, by the triangle inequality on the distances of
its halves to the centroids and the cells' radii, which come from all vectors. That finds every link, with more visits; where vectors
lie in no clusters it is nearly all cells. So its cells and blocks are large (exact_block()), and a vector is sent to few of them; the
pairs that are compared grow with the square of a label's size, which is the nature of the exact way, and memory doesn't.

Of two cells, only vectors of the lower one visit the higher, so a pair is met once; a pair in one cell is met from both ends and counts for
one at each. Equal vectors of a label are one node. A cell's vectors and its visitors are split into blocks of BLOCK, and each pair of
blocks is a task's group: what it returns is sums and a forest, linear in its rows.

Components are kept as the column has them: single precision as it is, all other numbers in double precision. Labels can be of any type
that Spark casts to text; two labels are equal if their texts are (so 0.0 and -0.0 are, and NaN equals NaN).

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with nothing;
vectors of different lengths don't link; equal vectors tie and are one node; null vec_ids take part but name no component (its smallest non-null id does; null if none);
repeated rows are copies, linked to each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, FractionalType

from .common import sample_of, save
from .components import components, forest, run_groups

THRESHOLD, TARGET = 0.93, 0.999
SAMPLE, BLOCK = 4096, 512
#: Of the exact way: bytes of a block's vectors, and most vectors of one.
EXACT_BYTES, EXACT_ROWS = 8 << 20, 16_384


def component_type(df: DataFrame) -> str:
    """How `vec` holds the components of df's embeddings: single precision if the column is, else double."""
    return "<f4" if isinstance(df.schema["embedding"].dataType.elementType, FloatType) else "<f8"


def valid_vectors(df: DataFrame) -> DataFrame:
    """vec_id, label (as text), node (hash of label and vector; null if the row links with nothing), vec (its components as component_type() says)."""
    kind = component_type(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, vecs = [], []
            for label, vec in zip(batch.column("label").to_pylist(), batch.column("embedding"), strict=True):
                x = None
                if label is not None and vec.is_valid and len(vec) and not vec.values.null_count:
                    x = vec.values.to_numpy().astype(kind)
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                name = b"" if x is None else label.encode()
                nodes.append(None if x is None else xxhash.xxh3_128_digest(len(name).to_bytes(8, "little") + name + (x + 0).tobytes()))
                vecs.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(nodes, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "label", "node", "vec"])

    label = F.col("label") + 0.0 if isinstance(df.schema["label"].dataType, FractionalType) else F.col("label")
    numbers = F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("string").alias("label"), numbers.alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, label string, node binary, vec binary")


def unit(vecs: list[bytes], kind: str = "<f4") -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * x @ centroids.T, 0)


def fit_codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means; k is at most the number of distinct rows."""
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = _distances(x, c).argmin(1)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def traverse(a: np.ndarray, b: np.ndarray, visits: int) -> np.ndarray:
    """(rows, visits) cells in rising sum of the two halves' distances. A cell of the ranks i and j comes after the (i + 1)(j + 1) - 1
    cells of lower ranks, so only ranks with (i + 1)(j + 1) <= visits are looked at."""
    visits = min(visits, a.shape[1] * b.shape[1])
    ra, rb = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
    i, j = np.meshgrid(np.arange(min(visits, a.shape[1])), np.arange(min(visits, b.shape[1])), indexing="ij")
    near = (i + 1) * (j + 1) <= visits
    i, j = i[near], j[near]
    sums = np.take_along_axis(a, ra, 1)[:, i] + np.take_along_axis(b, rb, 1)[:, j]
    order = np.argsort(sums, axis=1, kind="stable")[:, :visits]
    return np.take_along_axis(ra[:, i] * b.shape[1] + rb[:, j], order, 1)


def calibrate(sample: np.ndarray, halves: list[np.ndarray], threshold: float, target: float, rng: np.random.Generator) -> int:
    """Visits after which a vector turned to the threshold is met with the target probability."""
    x = sample[rng.choice(len(sample), min(512, len(sample)), replace=False)]
    ranks = []
    for _ in range(4):
        u = rng.standard_normal(x.shape)
        u -= (u * x).sum(1, keepdims=True) * x
        u /= np.maximum(np.sqrt((u * u).sum(1, keepdims=True)), 1e-12)
        y = threshold * x + np.sqrt(1 - threshold**2) * u
        da, db = (_distances(p, c) for p, c in zip(_split(x), halves, strict=True))
        ya, yb = (_distances(p, c).argmin(1) for p, c in zip(_split(y), halves, strict=True))
        own = np.take_along_axis(da, ya[:, None], 1) + np.take_along_axis(db, yb[:, None], 1)
        for k in range(len(x)):
            ranks.append(int((da[k][:, None] + db[k] <= own[k]).sum()))
    return int(np.quantile(ranks, target, method="higher"))


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = (x.shape[1] + 1) // 2
    return x[:, :half], x[:, half:] if x.shape[1] > 1 else x[:, :half] * 0


@dataclass
class Index:
    """Of one vector length: two codebooks, and either the number of visits or the radii of the codebooks' cells; how vectors are held."""

    halves: list[np.ndarray]
    visits: int = 1
    kind: str = "<f4"
    radii: list[np.ndarray] | None = None

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [_distances(p, c) for p, c in zip(_split(x), self.halves, strict=True)]


def exact_block(length: int) -> int:
    """Vectors of `length` bytes in a block of the exact way."""
    return max(BLOCK, min(EXACT_ROWS, EXACT_BYTES // max(1, length)))


def fit(nodes: DataFrame, threshold: float, target: float, kind: str = "<f4", seed: int = 7) -> dict[int, Index]:
    """By vector length. From the nodes of lowest hash; with n nodes in the largest label, a codebook has about sqrt(n / BLOCK * 4) centroids, or
    sqrt(n / exact_block()) for the exact way."""
    rng = np.random.default_rng(seed)
    n = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    block = exact_block(nodes.agg(F.max(F.length("vec"))).first()[0] or 0) if target >= 1 else BLOCK / 4
    k = max(1, math.ceil(math.sqrt(n / block)))
    rows = sample_of(nodes.select("node", "vec"), "node", max(SAMPLE, 16 * k)).select("vec").collect()
    by_length: dict[int, list[bytes]] = {}
    for r in rows:
        by_length.setdefault(len(r["vec"]), []).append(bytes(r["vec"]))
    index = {}
    for length, vecs in by_length.items():
        x = unit(vecs, kind)
        halves = [fit_codebook(p, k, rng) for p in _split(x)]
        index[length] = Index(halves, 1 if target >= 1 else max(1, calibrate(x, halves, threshold, target, rng)), kind)
    if target >= 1:
        for found in index.values():
            found.radii = [np.zeros(len(c)) for c in found.halves]
        for r in _radii(nodes, index).collect():  # a row for each centroid
            index[r["length"]].radii[r["half"]][r["centroid"]] = r["radius"]
    return index


def _by_length(vecs: list[bytes], index: dict[int, Index]):
    """(index, rows, unit vectors) for each length that has an index."""
    for length in {len(v) for v in vecs} & index.keys():
        rows = [k for k, v in enumerate(vecs) if len(v) == length]
        yield index[length], rows, unit([vecs[k] for k in rows], index[length].kind)


def _radii(nodes: DataFrame, index: dict[int, Index]) -> DataFrame:
    """length, half, centroid, radius: the largest distance of the centroid's own vectors in that half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[tuple[int, int, int], float] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                vecs = batch.slice(start, 512).column("vec").to_pylist()
                for found, rows, x in _by_length(vecs, index):
                    for half, d in enumerate(found.distances(x)):
                        for c, r in zip(d.argmin(1).tolist(), np.sqrt(d.min(1)).tolist(), strict=True):
                            key = (len(vecs[rows[0]]), half, c)
                            most[key] = max(most.get(key, 0.0), r)
        if most:
            yield pa.RecordBatch.from_pylist([{"length": a, "half": b, "centroid": c, "radius": r} for (a, b, c), r in most.items()])

    return nodes.select("vec").mapInArrow(run, "length long, half long, centroid long, radius double").groupBy("length", "half", "centroid").agg(F.max("radius").alias("radius"))


def place(nodes: DataFrame, index: dict[int, Index], threshold: float) -> DataFrame:
    """nodes with cell and visits (the cells to visit, own one included, lower ones left out). A length that the sample doesn't hold
    has one cell."""
    reach = max(0.0, 2 - 2 * threshold) + 1e-9  # the largest squared distance of two linked unit vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                vecs = part.column("vec").to_pylist()
                cells, visits = [0] * len(vecs), [[0]] * len(vecs)
                for found, rows, x in _by_length(vecs, index):
                    da, db = found.distances(x)
                    own = da.argmin(1) * db.shape[1] + db.argmin(1)
                    if found.radii:
                        la, lb = (np.maximum(np.sqrt(d) - r, 0) ** 2 for d, r in zip((da, db), found.radii, strict=True))
                        there = [np.flatnonzero(a[:, None] + b <= reach).tolist() for a, b in zip(la, lb, strict=True)]
                    else:
                        there = traverse(da, db, found.visits).tolist()
                    for k, c, v in zip(rows, own.tolist(), there, strict=True):
                        cells[k], visits[k] = c, [c, *(y for y in v if y > c)]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("label"), part.column("vec"), part.column("copies"), pa.array(cells, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], ["node", "label", "vec", "copies", "cell", "visits"])

    return nodes.select("node", "label", "vec", "copies").mapInArrow(run, "node binary, label string, vec binary, copies long, cell int, visits array<int>")


_found = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])


def close_pairs(left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of the unit vectors left[x], right[y] whose product is at least threshold, a run of left's rows at a time. Products in single precision,
    whose error is below `slack`, tell which pairs can be; those are worked out in double precision."""
    a, b = left.astype(np.float32), right.astype(np.float32)
    slack = (left.shape[1] + 4) * 2.0**-23
    for start in range(0, len(left), BLOCK):
        x, y = np.nonzero(a[start : start + BLOCK] @ b.T >= np.float32(threshold - slack))
        for k in range(0, len(x), 1 << 16):
            p, q = x[k : k + (1 << 16)] + start, y[k : k + (1 << 16)]
            sure = np.einsum("ij,ij->i", left[p], right[q]) >= threshold
            yield p[sure], q[sure]


def compare_large(group: list[dict], threshold: float, kind: str) -> list[tuple]:
    """What meet() finds in a group of the exact way."""
    left, right = [r for r in group if r["from"] >= 0], [r for r in group if r["from"] < 0]
    if not left or not right:
        return []
    names: dict[bytes, int] = {}
    p, q = (np.array([names.setdefault(r["node"], len(names)) for r in side]) for side in (left, right))
    weight_p, weight_q = (np.array([r["copies"] for r in side], np.float64) for side in (left, right))
    came = np.array([r["from"] != group[0]["cell"] for r in left])  # pairs of different cells are met here only
    totals, root, edges, at = np.zeros(len(names)), np.arange(len(names)), [], list(names)
    for x, y in close_pairs(unit([r["vec"] for r in left], kind), unit([r["vec"] for r in right], kind), threshold):
        other = p[x] != q[y]
        x, y = x[other], y[other]
        totals += np.bincount(p[x], weight_q[y], len(at))
        totals += np.bincount(q[y[came[x]]], weight_p[x[came[x]]], len(at))
        ends = np.stack([root[p[x]], root[q[y]]], 1)
        for i, j in np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0).tolist():
            if root[i] != root[j]:
                root[root == max(root[i], root[j])] = min(root[i], root[j])
                edges.append((i, j))
    return [(at[k], None, int(totals[k])) for k in np.flatnonzero(totals).tolist()] + [(at[i], at[j], None) for i, j in edges]


def meet(placed: DataFrame, threshold: float, kind: str = "<f4", exact: bool = False) -> DataFrame:
    """Rows a, null, n (n documents linked to a) and a, b, null (an edge)."""
    key = ["label", "length", "cell"]
    placed = placed.withColumn("length", F.length("vec"))
    goes = placed.select("label", "length", F.explode("visits").alias("cell"), F.col("cell").alias("from"), "node")
    visitors = goes.groupBy(key).agg(F.count("*").alias("nq"))
    sizes = placed.groupBy(key).agg(F.count("*").alias("ni")).join(visitors, key)  # cells without vectors drop out
    block = F.greatest(F.lit(BLOCK), F.least(F.lit(EXACT_ROWS), F.floor(F.lit(EXACT_BYTES) / F.col("length")))) if exact else F.lit(BLOCK)
    blocks = sizes.select(*key, *(F.ceil(F.col(x) / block).cast("int").alias(y) for x, y in (("ni", "bi"), ("nq", "bq"))))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = ["node", "from"]
    stay = placed.withColumn("from", F.lit(-1)).join(blocks, key).select(*key, part("bi").alias("i"), each("bq").alias("q"), *rest)
    come = goes.join(blocks, key).select(*key, each("bi").alias("i"), part("bq").alias("q"), *rest)

    def compare(group: list[dict]) -> list[tuple]:
        if exact:
            return compare_large(group, threshold, kind)
        left, right = [r for r in group if r["from"] >= 0], [r for r in group if r["from"] < 0]
        if not left or not right:
            return []
        close = unit([r["vec"] for r in left], kind) @ unit([r["vec"] for r in right], kind).T >= threshold
        names, places = {}, []
        for r in (*left, *right):
            places.append(names.setdefault(r["node"], len(names)))
        place_ = np.array(places)
        p, q = place_[: len(left)], place_[len(left) :]
        close &= p[:, None] != q
        if not close.any():
            return []
        totals = np.zeros(len(names), np.int64)
        np.add.at(totals, p, close @ np.array([r["copies"] for r in right], dtype=np.int64))
        came = np.array([r["from"] != group[0]["cell"] for r in left])  # pairs of different cells are met here only
        np.add.at(totals, q, (close & came[:, None]).T @ np.array([r["copies"] for r in left], dtype=np.int64))
        at = list(names)
        x, y = np.nonzero(close)
        edges = forest(zip(p[x].tolist(), q[y].tolist(), strict=True), len(at))
        return [(at[k], None, int(totals[k])) for k in np.flatnonzero(totals).tolist()] + [(at[i], at[j], None) for i, j in edges]

    # Nodes are dealt to blocks by name; those that have a block to meet fetch their vectors once for each.
    dealt = stay.unionByName(come).join(placed.select("node", "vec", "copies"), "node")
    return run_groups(dealt, [*key, "i", "q"], compare, "a binary, b binary, n long", _found)


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    kind = component_type(df)
    rows = save(valid_vectors(df), "vectors")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    nodes = save(nodes, "nodes")
    placed = save(place(nodes, fit(nodes, threshold, target, kind), threshold), "placed")
    found = save(meet(placed, threshold, kind, target >= 1), "met")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    joined = components(found.where("b IS NOT NULL"))
    per_node = nodes.select("node", "copies", "least_id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")).join(links, "node", "left")
    names = per_node.groupBy("component").agg(F.min("least_id").alias("component_id"))
    per_node = per_node.join(names, "component").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = F.col("node").isNull()
    return (
        rows.select("vec_id", "node")
        .join(per_node, "node", "left")
        .select("vec_id", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
