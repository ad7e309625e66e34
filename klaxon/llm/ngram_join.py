"""N-gram Jaccard join by a MinHash LSH forest. Each text has TREES signatures of DEPTH MinHash values. A tree's signatures are sorted,
so its texts stand as in a prefix trie, and the longest common prefix of neighbours shows where branches begin:

1. Texts with equal shingle sets are one class from the start.
2. Longest prefixes: each text meets the first texts of the deepest branches that it stands in (of the NEAREST longest matches in all
   trees), and similar ones merge. This takes near copies together at the cost of a few comparisons each.
3. Prefixes are shortened by STEP values at a time, from DEPTH down. At each length, a branch whose texts are one class, or which a longer prefix
   holds as well, is done; in others all pairs of different classes are compared, in blocks. After each length, the links found so far,
   weighed by the probability that links of their similarity meet at this length, tell the recall in each band of similarity (steps
   of BAND). Shortening stops where a length finds nothing new and every band that holds links has the target recall, and at the
   latest at `depth_for(...)`, where a pair at the threshold itself meets in some tree with the target probability.
4. Links are counted inside the components, exactly and over all pairs, in blocks; so a link can be missed only where it is the
   sole way between two parts of a component, with the probability that the target leaves.

A target of 1 asks for the exact way: instead of the forest, each text is looked up by the smallest hashes of its shingles, so many that
two texts at the threshold must share one (prefix filter). It meets all pairs, at a higher cost for long texts.

Every comparison is of whole shingle sets (of 64-bit hashes). Tasks give forests and sums, not pairs, so what they return is linear in
their rows even in large groups of near copies.

Words are what white space parts, in lower case. A shingle is five words in a row; a shorter text is one shingle. Defined results: a
null text or one without words links with nothing; a very long text is one set of shingles like others, held by the task that compares it; rows
with null ids take part, and a class id is the smallest id of the class, nulls left out (null if it has none); equal sets tie and are one
node; repeated rows are copies of each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, slices, text_or_empty
from .components import block_pairs, components, forest, run_groups

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, TARGET = 16, 8, 0.9995
#: Texts of a block; two blocks meet in a task. Longest matches that a text meets first.
BLOCK, NEAREST = 128, 3
#: Values by which prefixes are shortened; pairs that a longer prefix joins are compared again with what a shorter one adds to their branch,
#: so smaller steps repeat more.
STEP = 2
#: Width of the bands of similarity in which recall is measured.
BAND = 0.05

_rng = np.random.default_rng(20240229)
_byte = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_factor = _rng.integers(0, 1 << 62, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def depth_for(threshold: float, target: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair of this similarity meets in one of the trees with the target probability."""
    for d in range(depth, 1, -1):
        if 1 - (1 - threshold**d) ** trees >= target:
            return d
    return 1


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for b in (_BASE, inverse):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers.clear()
        _powers[size] = tuple(both)
    return _powers[size]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_space = re.compile(r"[ \t\n\r\f\v]+")


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles. All texts lie in one array; a shingle's hash is a polynomial of
    its bytes, from prefix sums."""
    clean = [_space.sub(" ", t.lower()).strip(" ").encode() for t in texts]
    data = np.frombuffer(b" ".join(clean) + b" ", np.uint8)
    up, down = _tables(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte[data] * up[: len(data)])])
    ends = np.flatnonzero(data == 32)  # the end of each word; an empty text has one empty word
    starts = np.concatenate([[0], ends[:-1] + 1])
    text_ends = np.cumsum([len(c) + 1 for c in clean])
    first = np.searchsorted(ends, text_ends - 1) + 1
    first = np.concatenate([[0], first])  # of each text, its first word
    out = []
    counts = np.diff(first)
    last = np.repeat(first[1:], counts) - 1  # of each word, the last of its text
    upto = np.minimum(np.arange(len(ends)) + words - 1, last)
    h = _mix((sums[ends[upto]] - sums[starts]) * down[starts])
    for k, c in enumerate(clean):
        own = h[first[k] : first[k + 1]]
        out.append(np.unique(own[: max(1, len(own) - words + 1)]) if c else own[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, TREES * DEPTH) MinHash values of 32 bits; sets must not be empty."""
    out = np.empty((len(sets), len(_factor)), np.uint32)
    if not sets:
        return out
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    for k, f in enumerate(_factor):
        out[:, k] = np.minimum.reduceat((flat * f) >> np.uint64(32), at)
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections. Only hashes that occur twice are looked at, in runs of columns."""
    m = len(sets)
    out = np.zeros((m, m), np.float64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner = owner[shared]
    if len(owner):
        column = column[shared]
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        n, step = int(column[-1]) + 1, 8192
        bounds = np.searchsorted(column, np.arange(0, n + step, step))
        for k in range(0, -(-n // step)):
            a = np.zeros((m, min(step, n - k * step)), np.float32)
            part = slice(bounds[k], bounds[k + 1])
            a[owner[part], column[part] - k * step] = 1
            out += a @ a.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have at least this Jaccard similarity; compared without division, so 0.8 is met exactly."""
    both, sizes = overlaps(sets), np.array([len(s) for s in sets], dtype=np.float64)
    num, den = round(threshold * 1_000_000), 1_000_000
    return (both * den >= num * (sizes[:, None] + sizes - both)) & (both > 0)


def filter_hashes(shingle_set: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest hashes of a sorted set, so many that a set of this similarity has one of its own smallest among them."""
    least = -(-round(threshold * 1_000_000) * len(shingle_set) // 1_000_000)
    return shingle_set[: len(shingle_set) - least + 1]


def sign(docs: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), node (128-bit hash of the shingle set, null without words), sig: its MinHash values, or
    if `exact` its filter_hashes()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingles(part.column("text").to_pylist())
                full = [s for s in sets if len(s)]
                sigs = iter([filter_hashes(s, threshold).astype(">u8") for s in full] if exact else signatures(full).astype(">u4"))
                nodes, sig = [], []
                for s in sets:
                    nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sig.append(next(sigs).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(nodes, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "text_key", "node", "sig"])

    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, "doc_id long, text_key long, node binary, sig binary")


def tries(nodes: DataFrame, depth: int) -> DataFrame:
    """key, node, lcp, first, rest of the texts that share a prefix of at least `depth` with another in a tree. key names the tree and that
    prefix; lcp is the length of the prefix shared with the text before in sorted order (0 for the first of a key), first the first
    text of the branch of that length, and rest the values below the key's prefix. Trees are dealt out by key and sorted; a walk keeps one row and the begin of each branch."""
    rest, names = DEPTH - depth, ["key", "node", "lcp", "first", "rest"]
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = nodes.select("node", "sig", tree.alias("tree")).select(
        F.expr(f"xxhash64(tree, substring(sig, tree * {DEPTH * 4} + 1, {depth * 4}))").alias("key"), F.expr(f"substring(sig, tree * {DEPTH * 4} + {depth * 4 + 1}, {rest * 4})").alias("rest"), "node"
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins: list[bytes] = [b""] * (rest + 1)  # of the last row, the first text of its branch of each length
        last: tuple | None = None  # key, rest, node, lcp, first
        for batch in batches:
            if not batch.num_rows:
                continue
            before = [] if last is None else [last]
            keys = np.concatenate([np.array([x[0] for x in before], np.int64), batch.column("key").to_numpy()])
            values = np.frombuffer(b"".join([*(x[1] for x in before), *batch.column("rest").to_pylist()]) or bytearray(), ">u4").reshape(len(keys), rest)
            nodes_ = [*(x[2] for x in before), *batch.column("node").to_pylist()]
            lcp = np.zeros(len(keys), np.int64)
            common = np.logical_and.accumulate(values[1:] == values[:-1], axis=1).sum(1)
            lcp[1:] = np.where(keys[1:] == keys[:-1], depth + common, 0)
            at, first = np.arange(len(keys)), np.full(len(keys), -1)
            pool = [*begins, *nodes_]
            for d in range(depth, DEPTH + 1):
                # Where the branch of this length begins; one that began in an earlier batch is at the head of the pool.
                begin = np.where(lcp < d, at + rest + 1, -1)
                if before:
                    begin[0] = d - depth
                begin = np.maximum.accumulate(begin)
                first = np.where(lcp == d, begin, first)
                begins[d - depth] = pool[begin[-1]]
            firsts = [pool[k] if k >= 0 else None for k in first.tolist()]
            lengths = lcp.tolist()
            if before:
                lengths[0], firsts[0] = last[3], last[4]
            matched = np.array(lengths) >= depth
            keep = np.flatnonzero(matched[:-1] | (lcp[1:] >= depth)).tolist()
            last = (int(keys[-1]), values[-1].tobytes(), nodes_[-1], lengths[-1], firsts[-1])
            if keep:
                below = pa.array([values[k].tobytes() for k in keep], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array([nodes_[k] for k in keep], pa.binary()), pa.array([lengths[k] for k in keep], pa.int32()), pa.array([firsts[k] for k in keep], pa.binary()), below], names)
        if last is not None and last[3] >= depth:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[2]], pa.binary()), pa.array([last[3]], pa.int32()), pa.array([last[4]], pa.binary()), pa.array([last[1]], pa.binary())], names)

    return rows.repartition("key").sortWithinPartitions("key", "rest", "node").mapInArrow(walk, "key long, node binary, lcp int, first binary, rest binary")


def filtered(nodes: DataFrame) -> DataFrame:
    """key, node, lcp, first as tries() gives them, for signatures that are filter_hashes(): a key is a hash that several texts hold."""
    rows = nodes.select("node", F.explode(F.expr("transform(sequence(0, cast(length(sig) / 8 AS int) - 1), k -> xxhash64(substring(sig, k * 8 + 1, 8)))")).alias("key"))
    several = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    return rows.join(several, "key").select("key", "node", F.when(F.col("node") != F.col("first"), 1).otherwise(0).alias("lcp"), "first")


def similarity(s: np.ndarray, t: np.ndarray) -> float:
    n = len(np.intersect1d(s, t, assume_unique=True))
    return n / (len(s) + len(t) - n)


def _linked_pairs(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs a, b whose texts are similar, with their similarity."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_b", 1 << 20):
                a, b = part.column("text_a").to_pylist(), part.column("text_b").to_pylist()
                places = {t: k for k, t in enumerate(dict.fromkeys(a + b))}
                sets = shingles(list(places))
                keep, near = [], []
                for x, y in zip(a, b, strict=True):
                    s, t = sets[places[x]], sets[places[y]]
                    n = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(n * 1_000_000 >= round(threshold * 1_000_000) * (len(s) + len(t) - n))
                    near.append(n / (len(s) + len(t) - n))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(near, pa.float64())], ["a", "b", "near"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, near double")


_edges = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("near", pa.float64())])


def _largest(rows: DataFrame) -> DataFrame:
    """rows of the branches that hold several classes and longer prefixes (`longer`), with big (the branch's largest class), n_big (its nodes
    there) and rest (all others)."""
    sizes = rows.groupBy("key", "class").agg(F.count("*").alias("c"), F.min("longer").alias("lo"), F.max("longer").alias("hi"))
    big = sizes.groupBy("key").agg(F.max(F.struct("c", F.col("class").alias("big"))).alias("b"), F.sum("c").alias("n"), F.count("*").alias("classes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return rows.drop("longer").join(big.where("classes > 1 AND lo <> hi").select("key", F.col("b.big"), F.col("b.c").alias("n_big"), (F.col("n") - F.col("b.c")).alias("rest")), "key")


def _with_class(df: DataFrame, classes: DataFrame) -> DataFrame:
    return df.join(classes.select("node", "component"), "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")


def recalls(edges: DataFrame, depth: int) -> list[float]:
    """The recall, in each band of similarity that holds some of these links, of links that meet where prefixes have this length: the
    links found over the sum of their inverse probabilities to be found."""
    met = 1 - F.pow(1 - F.pow("near", F.lit(depth)), F.lit(TREES))
    bands = edges.groupBy(F.floor(F.col("near") / BAND + 1e-9).alias("band")).agg((F.count("*") / F.sum(1 / met)).alias("recall"))
    return [r["recall"] for r in bands.collect()]


def _compared(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """a, b, near: a forest of links between the classes that meet in a branch. rows: key, longer, node, class. Nodes outside the largest class
    of their branch meet its nodes, and each other. Nodes of one class need no comparison, so a large class is met by each of the
    others but not by itself."""
    rows = save(_largest(rows), "shortened")
    inside = F.col("class") == F.col("big")
    blocks = {x: F.ceil(F.col(x) / BLOCK).cast("int") for x in ("n_big", "rest")}
    own = F.pmod(F.xxhash64("node"), F.when(inside, blocks["n_big"]).otherwise(blocks["rest"])).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(inside, blocks["rest"]).otherwise(blocks["n_big"]) - 1))
    crossing = rows.withColumn("own", own).withColumn("other", other).select("key", F.when(inside, F.col("own")).otherwise(F.col("other")).alias("lo"), (-1 - F.when(inside, F.col("other")).otherwise(F.col("own"))).alias("hi"), "node", "class")
    among = block_pairs(rows.where(~inside & (F.col("rest") > 1)), "key", "node", "rest", BLOCK).select("key", "lo", "hi", "node", "class")
    rows = crossing.unionByName(among).join(texts, "node")

    def compare(group: list[dict]) -> list[tuple]:
        if len({r["class"] for r in group}) < 2:
            return []
        sets = shingles([r["text"] for r in group])
        close = similar(sets, threshold)
        i, j = np.nonzero(np.triu(close, 1))
        first: dict[bytes, int] = {}
        place = [first.setdefault(r["class"], k) for k, r in enumerate(group)]  # of each row, the first of its class
        pairs: dict[tuple[int, int], tuple[int, int]] = {}  # of two classes, two texts that link them
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            pairs.setdefault((place[x], place[y]), (x, y))
        return [(group[a]["class"], group[b]["class"], similarity(*(sets[k] for k in pairs[a, b]))) for a, b in forest((p for p in pairs if p[0] != p[1]), len(group))]

    return run_groups(rows.select("key", "lo", "hi", "node", "class", "text"), ["key", "lo", "hi"], compare, "a binary, b binary, near double", _edges)


def _merged(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """classes after links between classes (a node without one is its own)."""
    moved = components(edges).select(F.col("node").alias("was"), F.col("component").alias("now"))
    known = classes.join(moved, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))
    fresh = moved.join(classes, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("component"))
    return save(known.unionByName(fresh), "merged")


def link_classes(nodes: DataFrame, texts_of, threshold: float = THRESHOLD, target: float = TARGET) -> tuple[DataFrame, DataFrame, list[tuple[int, int, float]]]:
    """(node, component) of the nodes that have a link; (node, text) of all candidates; and of each prefix length that was tried, the length,
    the links that it found beyond longer ones, and the least recall of a band after it (1 if there are no links). texts_of(candidates)
    gives the text of each candidate node. A target of 1 has one step, of length 0."""
    exact = target >= 1
    floor = 0 if exact else depth_for(threshold, target)
    found = save(filtered(nodes) if exact else tries(nodes, floor), "branches")
    texts = save(texts_of(found.select("node").distinct()), "candidate-texts")
    longest = found.where("lcp > 0").groupBy("node").agg(F.slice(F.sort_array(F.collect_set(F.struct("lcp", "first")), False), 1, NEAREST).alias("met"))
    met = longest.select(F.col("node").alias("b"), F.explode("met.first").alias("a")).select("a", "b").distinct()
    edges = save(_linked_pairs(met, texts, threshold), "links")
    classes = save(components(edges), "merged")
    steps: list[tuple[int, int, float]] = []
    depths = [0] if exact else [*range(DEPTH, floor, -STEP), floor]
    for before, depth in zip([None, *depths], depths):  # noqa: B905  the last one is before none
        prefix = lambda d: F.xxhash64("key", F.expr(f"substring(rest, 1, {(d - floor) * 4})"))
        key = F.col("key") if exact else prefix(depth).alias("key")
        longer = F.xxhash64("node") if before is None else prefix(before)
        new = save(_compared(_with_class(found.select(key, longer.alias("longer"), "node"), classes), texts, threshold), "links")
        n = new.count()
        if n:
            classes, edges = _merged(classes, new), edges.unionByName(new)
        least = 1.0 if exact else min(recalls(edges, depth), default=1.0)
        steps.append((depth, n, least))
        if not n and least >= target:
            break
    return classes, texts, steps


_counts = pa.schema([("node", pa.binary()), ("n", pa.int64())])


def count_links(classes: DataFrame, copies: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, links (documents of other nodes that it is linked to)."""
    sizes = classes.groupBy("component").agg(F.count("*").alias("size"))
    rows = classes.join(sizes, "component").join(copies, "node")
    rows = block_pairs(rows, "component", "node", "size", BLOCK).join(texts, "node")

    def count(group: list[dict]) -> list[tuple]:
        sets, weight = shingles([r["text"] for r in group]), np.array([r["copies"] for r in group], dtype=np.int64)
        close = similar(sets, threshold)
        np.fill_diagonal(close, False)
        own = np.array([r["own"] for r in group])
        if group[0]["lo"] != group[0]["hi"]:  # pairs in one block count where it meets itself
            close &= own[:, None] != own
        totals = close @ weight
        return [(group[k]["node"], int(totals[k])) for k in np.flatnonzero(totals).tolist()]

    part = run_groups(rows.select("component", "lo", "hi", "own", "node", "copies", "text"), ["component", "lo", "hi"], count, "node binary, n long", _counts)
    return part.groupBy("node").agg(F.sum("n").alias("links"))


def _classes(docs: DataFrame, threshold: float, target: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(doc_id, text_key, node of every row; node, copies, least (the first of its rows), class of every node; node, component; node, text)."""
    signed = save(sign(docs, threshold, target >= 1), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("least")
    nodes = save(signed.where("node IS NOT NULL").groupBy("node").agg(F.first("sig").alias("sig"), F.count("*").alias("copies"), first), "nodes")

    def texts_of(candidates: DataFrame) -> DataFrame:
        source = nodes.join(candidates, "node", "left_semi").select("node", F.col("least.doc_id").alias("id"), F.col("least.text_key").alias("key"))
        text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        met = source.join(text, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.xxhash64("text")))
        return met.groupBy("node").agg(F.first("text").alias("text"))  # repeated rows give a text several times

    classes, texts, _ = link_classes(nodes.select("node", "sig"), texts_of, threshold, target)
    per_node = nodes.select("node", "copies", "least").join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    return signed.select("doc_id", "text_key", "node"), per_node, classes, texts


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), class_id (smallest doc_id of the class), n_links (documents linked directly), kept
    (doc_id = class_id, null equal to null)."""
    signed, per_node, classes, texts = _classes(docs, threshold, target)
    ids = per_node.groupBy("class").agg(F.min("least.doc_id").alias("class_id"))
    counted = count_links(classes, per_node.select("node", "copies"), texts, threshold)
    per_node = per_node.join(ids, "class").join(counted, "node", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    rows = signed.join(per_node.select("node", "class_id", "n_links"), "node", "left")
    alone = F.col("node").isNull()
    return rows.select(
        "doc_id",
        "text_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, that stay if one document of each class does: the one of the smallest id
    (nulls last), then of the smallest text hash; of rows that repeat its id and text, one. Rows without words all stay."""
    signed, per_node, _, _ = _classes(docs, threshold, target)
    first = per_node.groupBy("class").agg(F.min("least").alias("first"))
    per_node = per_node.join(first, "class").select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"))
    gone = signed.join(per_node, "node").where(~F.col("doc_id").eqNullSafe(F.col("first_id")) | (F.col("text_key") != F.col("first_key")))
    gone = save(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "gone")
    # The rows travel as one struct, so that none of their columns can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("key"))
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left_anti")
    if not signed.where("node IS NOT NULL").groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        words = F.coalesce(F.col("row.text").rlike(r"[^ \t\n\r\f\x0b]"), F.lit(False))
        rows = rows.where(words).dropDuplicates(["id", "key"]).unionByName(rows.where(~words))
    return rows.select("row.*")
