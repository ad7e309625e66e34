"""The pipeline against its stages one by one, each worked out by brute force from what the stage before kept."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from klaxon.llm import bpe, quality  # noqa: E402
from klaxon.llm.common import read  # noqa: E402

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_pipeline(spark):
    docs = read(spark, SF, "documents")
    first = corpus_pipeline.quality_classifier(spark, docs, SF)
    scored = {r["doc_id"]: r["predicted"] for r in quality.score_documents(docs, read(spark, SF, "labels")).collect()}
    kept = first.collect()
    assert first.columns == docs.columns and {r["doc_id"] for r in kept} == {d for d, p in scored.items() if p}
    sets = {r["doc_id"]: shingles(r["text"]) for r in kept}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    one = corpus_pipeline.ngram_jaccard_join(spark, first, SF)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {d for d in ids if find(d) == d}
    items = [set(zip(*(w[k:] for k in range(8)), strict=False)) for w in (r["text"].lower().split() for r in read(spark, SF, "benchmark").collect())]
    clean = corpus_pipeline.benchmark_decontamination(spark, one, SF)
    left = {r["doc_id"] for r in clean.collect()}
    for r in one.collect():
        w = r["text"].lower().split()
        own = set(zip(*(w[k:] for k in range(8)), strict=False))
        assert (r["doc_id"] in left) == (not any(own & x for x in items))
    want = {tuple(r) for r in bpe.encode_documents(docs.where(docs.doc_id.isin(sorted(left)))).collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]


def test_stages_on_an_empty_table(spark):
    docs = read(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_awkward_rows_and_columns_of_inner_names(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, and columns that stages use names like."""
    r = random.Random(9)
    vocabulary = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 8))) for _ in range(400)]
    prose = lambda n: (" ".join(r.choice(vocabulary) for _ in range(n)) + ".").capitalize()
    leak, twin = prose(30), prose(60)
    rows = [(k, prose(50)) for k in range(60)] + [(200 + k, " ".join(["###", "BUY", "!!!"] * 12)) for k in range(30)]
    rows += [(70, prose(40) + " " + leak), (71, twin), (71, twin), (72, twin), (None, twin), (None, prose(45)), (73, prose(8_000)), (74, None), (75, ""), (71, twin + " more")]
    docs = spark.createDataFrame([(d, t, 1, "a", "b", 2, "c", 3) for d, t in rows], "doc_id long, text string, leak_id int, leak_key string, gone_id string, key int, row string, id int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 200), 0) for d, _ in rows if d is not None and (d < 60 or d >= 200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = f"file://{tmp_path}"
    docs = read(spark, at, "documents")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((x["doc_id"] for x in df.select("doc_id").collect()), key=str)
    first = stages["quality classifier"](spark, docs, at)
    kept = ids(first)
    assert first.columns == docs.columns and not [d for d in kept if d is not None and d >= 200] and len([d for d in kept if d is not None and d < 60]) > 55
    one = stages["n-gram Jaccard join"](spark, docs, at)
    assert one.columns == docs.columns and [d for d in ids(one) if d in (71, 72)] == [71] and ids(one).count(None) == 1 and {74, 75} <= set(ids(one))
    clean = stages["benchmark decontamination"](spark, docs, at)
    assert clean.columns == docs.columns and sorted(map(str, ids(clean))) == sorted(str(d) for d, _ in rows if d != 70)
    out = [x["doc_id"] for x in corpus_pipeline.run(spark, at).collect()]
    assert 70 not in out and out.count(71) <= 1 and not [d for d in out if d is not None and d >= 200]
    assert corpus_pipeline.run(spark, at).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_scratch_tables_go(spark):
    from pyarrow import fs

    from klaxon.llm import common

    mark = common.scratch_mark()
    corpus_pipeline.run(spark, SF).collect()
    left = common._made[mark:]
    assert len(left) == 1  # what the last stage reads
    common.free(mark)
    store, base = fs.FileSystem.from_uri(left[0])
    assert common._made[mark:] == [] and store.get_file_info(base).type == fs.FileType.NotFound
