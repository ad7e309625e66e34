"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), and work on bounded groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, save, scratch_mark


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) of every node that has an edge. Nodes can be of any type with an order. A hub's
    neighbours are never gathered: each step takes minima by node, then joins them back."""
    mark = scratch_mark()
    e = save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        if least.where("m < u AND n > 1").isEmpty():  # a forest of stars: every node but the centres has one edge, to its centre
            break
        large = both.where("v > u").join(least.select("u", F.least("u", "m").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        free(mark, mark + 1)  # the edges of the step before
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def run_groups(df: DataFrame, keys: list[str], work: Callable[[list[dict]], list[tuple]], schema: str, arrow: pa.Schema, parts: int | None = None) -> DataFrame:
    """work() over the rows of each group of `keys`, whose size the caller bounds; without the cost of a pandas frame for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, [], []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), arrow, strict=True)], arrow.names)

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for row in batch.slice(k, 256).to_pylist():
                    key = tuple(row[x] for x in keys)
                    if key != at and rows:
                        out += work(rows)
                        rows = []
                        if len(out) > 5_000:
                            yield batch_of(out)
                            out = []
                    at = key
                    rows.append(row)
        if rows:
            out += work(rows)
        if out:
            yield batch_of(out)

    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


def forest(pairs: Iterator[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The pairs that join two parts when they come: a spanning forest over n places."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


def block_pairs(df: DataFrame, key: str, item: str, size: str, block: int) -> DataFrame:
    """Rows of df once for each pair of blocks of their group that they are part of, as columns lo and hi. `size` holds the number
    of a group's rows; a group has ceil(size / block) blocks, so a pair has about 2 * block rows whatever the group's size, and
    any two rows of a group meet in one pair at least (in all pairs of their block, if they share it)."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(item), blocks).cast("int")
    return (
        df.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
        .drop("other", size)
    )
