"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from klaxon.llm import chat, decontam, embed_dedup, html_extract, ngram_join, quality, sharding, warc
from klaxon.llm.components import components

R = random.Random(5)
VOCABULARY = ["".join(R.choices("abcdefghijklmnopqrstuvwxyz", k=R.randint(3, 9))) for _ in range(900)]


def prose(n, r=R):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def near(text, changes, r=R):
    words = text.split()
    for k in r.sample(range(len(words)), changes):
        words[k] = r.choice(VOCABULARY)
    return " ".join(words)


def frame(spark, rows):
    """doc_id, text and columns whose names the operators use inside."""
    return spark.createDataFrame([(a, b, "x", 1, "y", 2.0) for a, b in rows], "doc_id long, text string, node string, n int, shard string, score double").repartition(3)


AWKWARD = [(1, None), (2, ""), (3, "   \n"), (4, "same text"), (4, "same text"), (None, "no id"), (None, None), (5, "long " * 20_000), (6, "same text"), (7, "Same  TEXT")]


def roots(ids, links):
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in ids}


def test_components(spark):
    links = [(R.randrange(300), R.randrange(300)) for _ in range(170)] + [(0, k) for k in range(300, 420)]
    nodes = {x for p in links for x in p if p[0] != p[1]}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in roots({x for p in links for x in p}, links).items() if k in nodes}


# 1: embeddings
def brute_vectors(rows):
    ok = [(k, lab, np.array(v, np.float64)) for k, lab, v in rows if lab is not None and v is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for i, (a, la, x) in enumerate(ok) for b, lb, y in ok[i + 1 :] if la == lb and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93]
    return links


def test_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    rows = [(k, k % 3, (centres[k % 12] + 0.22 * rng.standard_normal(16)).astype(np.float32).tolist()) for k in range(240)]
    rows += [(1000 + k, 1, centres[0].astype(np.float32).tolist()) for k in range(40)]  # copies
    rows += [(2000, 1, None), (2001, 1, [0.0] * 16), (2002, 1, [float("nan")] * 16), (2003, 1, [None] + [1.0] * 15), (2004, None, rows[0][2]), (2005, 1, [])]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, label int, embedding array<float>, node string, cell int").repartition(4)
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    links = brute_vectors(rows)
    part = roots([r[0] for r in rows], links)
    assert {k: r["component_id"] for k, r in got.items()} == part
    assert {k: r["n_links"] for k, r in got.items()} == {k: sum(k in p for p in links) for k in part}
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())
    assert embed_dedup.near_duplicates(df.where("false")).collect() == []


@pytest.mark.parametrize("target", [embed_dedup.TARGET, 1.0])
def test_vectors_in_many_cells(spark, monkeypatch, target):
    """A table whose index prunes: at least 0.99 of the brute-force links are found, and by the exact way all."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((150, 32))
    rows = [(k, k % 2, (centres[(k // 2) % 150] + rng.choice([0.1, 0.24]) * rng.standard_normal(32)).astype(np.float32).tolist()) for k in range(1500)]
    rows += [(2000 + k, 0, rows[k][2]) for k in range(0, 20, 2)] + [(3000, 1, [1.0] * 8), (3001, 1, [1.0] * 8), (None, 0, rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(4)
    nodes = embed_dedup.valid_vectors(df).where("node IS NOT NULL").withColumn("copies", F.lit(1).cast("long"))
    index = embed_dedup.fit(nodes, 0.93, target)
    assert len(index[128].halves[0]) > 10
    if target < 1:
        assert index[128].visits < 0.6 * len(index[128].halves[0]) ** 2  # cells are left out
    by = {}
    for k, (_, label, v) in enumerate(rows):
        by.setdefault((label, len(v)), []).append(k)
    links = []
    for mine in by.values():
        x = np.array([rows[k][2] for k in mine], np.float64)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        i, j = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
        links += [(mine[a], mine[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    got = embed_dedup.near_duplicates(df, target=target).collect()
    found = sum(r["n_links"] for r in got) / 2
    assert len(links) > 1000 and 0.99 * len(links) <= found <= len(links)
    if target == 1:
        n = {}
        for a, b in links:
            n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
        assert {r["vec_id"]: r["n_links"] for r in got} == {rows[k][0]: n.get(k, 0) for k in range(len(rows))}


def test_vectors_of_doubles_and_labels_of_text(spark):
    """Components beyond single precision link by their cosine; labels are whatever they are, and a label's text is no part of another's."""
    big = [(1, "a", [1e39, 1.0]), (2, "a", [1e39, 1.0]), (3, "a", [1e-50, 0.0]), (4, "a", [1e-50, 0.0]), (5, "a", [5e-324, 0.0]), (6, "b", [1e39, 1.0]), (7, "a", [0.0, 1e300]), (8, None, [1e39, 1.0])]
    big += [(9, "c", [1.0, 1e-9]), (10, "c", [1.0, 1.1e-9]), (11, "c", [1.0, None]), (12, "c", [float("inf"), 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(spark.createDataFrame(big, "vec_id long, label string, embedding array<double>")).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (4, 1), 6: (0, 6), 7: (0, 7), 8: (0, 8), 9: (1, 9), 10: (1, 9), 11: (0, 11), 12: (0, 12)}
    rows = [(1, 0.0, [3, 4]), (2, -0.0, [6, 8]), (3, 1.0, [3, 4])]
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id int, label double, embedding array<int>")).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


# 2: shards
def test_shards(spark):
    rows = AWKWARD + [(100 + k, prose(R.randint(1, 200))) for k in range(600)] + [(1000 + k, "hot copy " * 40) for k in range(300)]
    got = sharding.shard_documents(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    # The group of copies is larger than an even shard. Shards are even where it may be split; whole, it makes one shard larger.
    for placed, most in ((sharding.assign(frame(spark, rows), split_above=0.25)[0].collect(), None), (got, 300 * 361)):
        bytes_ = [0] * 8
        for r in placed:
            bytes_[r["shard"]] += r["size"]
        even = sum(bytes_) / 8
        assert most or max(bytes_) - min(bytes_) < 0.35 * even  # one text of 100,000 bytes is among them
        rest = sorted(bytes_)[:6]
        assert rest[-1] - rest[0] < 0.02 * even and max(bytes_) <= max(most or 0, 1.3 * even)
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shard_documents(frame(spark, rows).where("false")).collect() == []
    by_text = {}
    for r in got:
        by_text.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(x) == 1 for x in by_text.values())  # equal texts are whole


def test_slot_map_is_stored_and_edited(spark, tmp_path):
    folder = f"file://{tmp_path}/map"
    docs = frame(spark, [(k, prose(R.randint(1, 60))) for k in range(400)])
    placed, now = sharding.assign(docs, folder=folder)
    assert {r["vslot"]: r["shard"] for r in placed.collect()} == {r["vslot"]: r["shard"] for r in now.collect()}
    first, second = ({r["vslot"]: r["shard"] for r in sharding.read_map(spark, folder, v).collect()} for v in (0, 1))
    assert first == {k: k % 8 for k in first} and second == {r["vslot"]: r["shard"] for r in now.collect()} and first != second
    # A later run goes on from the stored map: slots of before stay but for those that even the shards.
    _, later = sharding.assign(docs.unionByName(frame(spark, [(1000 + k, prose(20)) for k in range(40)])), folder=folder)
    third = {r["vslot"]: r["shard"] for r in later.collect()}
    assert {r["version"] for r in later.collect()} == {2} and sum(third[k] == s for k, s in second.items()) > 0.8 * len(second) and len(third) > len(second)
    grown = {r["vslot"]: r["shard"] for r in sharding.add_shard(now, 8).collect()}
    moved = {k for k in second if grown[k] != second[k]}
    assert moved and {grown[k] for k in moved} == {8}


def test_a_hot_group_of_copies(spark):
    rows = [(k, prose(40)) for k in range(600)] + [(1000 + k, "hot copy " * 25) for k in range(300)] + [(None, "same")] * 300
    docs = frame(spark, rows)
    whole = sharding.shard_documents(docs).collect()
    assert len({r["shard"] for r in whole if r["size"] == 226}) == 1 and len(whole) == len(rows)
    for s in range(8):
        assert sorted(r["slot"] for r in whole if r["shard"] == s) == list(range(sum(r["shard"] == s for r in whole)))
    split = sharding.assign(docs, split_above=0.25)[0].collect()
    sizes = [sum(r["size"] for r in split if r["shard"] == s) for s in range(8)]
    assert max(sizes) < 1.02 * min(sizes)


# 3: WARC
def test_warc(spark):
    big = "<p>" + "é" * 600
    rows = [(1, "u1", big), (2, "u\r\n2", big), (9, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "u", "<html>" + prose(60_000)), (9, "again", big)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted((tuple(r) for r in warc.archive_pages(df).collect()), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and page != 9
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert got == sorted(want, key=str)
    index = warc.write(df)
    every = index.collect()
    assert len({(r["path"], r["offset"]) for r in every}) == len(rows)
    from pyarrow import fs

    ids = set()
    for r in every:
        store, base = fs.FileSystem.from_uri(r["folder"])
        with store.open_input_file(f"{base}/{r['path']}") as f:
            headers, _ = warc.parse(zlib.decompress(f.read_at(r["length"], r["offset"]), 31))
        ids.add(headers["WARC-Record-ID"])
        assert ("WARC-Refers-To-Target-URI" in headers) == (r["record_type"] == "revisit")
    assert len(ids) == len(rows)
    chosen = warc.read_records(index.where("page_id = 6")).collect()
    assert len(chosen) == 1 and bytes(chosen[0]["payload"]).decode() == rows[7][2]
    assert warc.archive_pages(df.where("false")).collect() == []


# 4: quality
def test_quality_learns_content(spark):
    r = random.Random(3)
    words = VOCABULARY[:]
    r.shuffle(words)
    text = lambda own: " ".join(r.choice(own) for _ in range(60)).capitalize() + "."
    docs = [(k, text(words[:450] if k % 2 else words[450:])) for k in range(900)]  # the same surface, other words
    labels = spark.createDataFrame([(k, k % 2, 0) for k, _ in docs], "doc_id long, quality int, toxic int")
    held = [x for x in quality.score_documents(frame(spark, docs), labels).collect() if x["held_out"]]
    assert len(held) > 100 and sum(x["predicted"] == x["doc_id"] % 2 for x in held) > 0.9 * len(held)


def test_quality_against_plain_python(spark):
    """Weights minimise the pairs' loss as written out pair by pair; scores are the logistic curve of the weighted features."""
    r = np.random.default_rng(4)
    texts = [prose(int(r.integers(1, 40))) + r.choice(["", "!!!", " 123"]) for _ in range(60)]
    x, y = np.array([quality.features(t) for t in texts]), (r.random(60) > 0.4).astype(float)
    ranker = quality.rank(x, y, pairs=500)
    rng, n = np.random.default_rng(11), min(500, int(y.sum() * (60 - y.sum())))
    pairs = list(zip(rng.choice(np.flatnonzero(y == 1), n), rng.choice(np.flatnonzero(y == 0), n), strict=True))
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-6)
    ridge = np.array([quality.RIDGE_SURFACE] * len(quality.SURFACE) + [quality.RIDGE_CONTENT] * 2 * quality.HASHED)
    loss = lambda w: sum(np.log1p(np.exp(-(z[i] - z[j]) @ w)) for i, j in pairs) / n + 0.5 * (ridge * w * w).sum()
    # The slope is divided out: along the found direction the least loss is where the ranking was learned.
    w = ranker.weights * np.maximum(x.std(0), 1e-6)
    found = min((loss(w * k), k) for k in np.geomspace(0.01, 100, 400))
    best = w * found[1]
    for _ in range(30):
        assert loss(best + 0.05 * np.linalg.norm(best) / np.sqrt(len(best)) * r.standard_normal(len(best))) > found[0] - 1e-4
    docs = [(k, t) for k, t in enumerate(texts)]
    labels = spark.createDataFrame([(k, int(v), 0) for k, v in enumerate(y)], "doc_id long, quality int, toxic int")
    fitted = quality.fit(frame(spark, docs), labels)
    for row in quality.score_documents(frame(spark, docs), labels).collect():
        plain = 1 / (1 + np.exp(-(sum(float(a) * b for a, b in zip(quality.features(texts[row["doc_id"]]), fitted.weights, strict=True)) + fitted.bias)))
        assert abs(row["score"] - plain) < 1e-6


def test_quality(spark):
    good = [(k, prose(80).capitalize() + ".") for k in range(300)]
    bad = [(1000 + k, " ".join(["###", "BUY", "!!!"] * R.randint(5, 60))) for k in range(150)]
    docs = frame(spark, good + bad + AWKWARD)
    labels = spark.createDataFrame([(k, int(k < 1000), 0) for k, _ in good + bad] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(good + bad + AWKWARD)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d, _ in good + bad + AWKWARD if d is not None and zlib.crc32(str(d).encode()) % 5 == 0}
    right = [r["predicted"] == int(r["doc_id"] < 1000) for r in held if r["doc_id"] < 300 and r["doc_id"] > 7 or r["doc_id"] >= 1000]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert quality.score_documents(docs.where("false"), labels).collect() == []
    assert quality.score_documents(docs, labels.where("false")).count() == len(good + bad + AWKWARD)
    # Labels of held-out rows change nothing.
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda x: sorted((str(r["doc_id"]), r["score"]) for r in quality.score_documents(docs, x).collect())
    assert scores(labels) == scores(turned)


# 5: decontamination
def test_leaks(spark):
    items = [(k, prose(R.randint(16, 60)) + ". " + prose(5)) for k in range(30)]
    clean = [(k, prose(R.choice([3, 50, 400]))) for k in range(250)]
    planted = {(500 + k, k): prose(R.choice([0, 10, 300])) + " " + t + " " + prose(40) for k, t in items}
    changed = {(600 + k, k): prose(60) + " " + near(t, len(t.split()) // 10) + " " + prose(60) for k, t in items}
    rows = clean + [(d, t) for (d, _), t in (planted | changed).items()] + AWKWARD
    benchmark = spark.createDataFrame([(k, t, "x") for k, t in items] + [(900, None, ""), (901, " ", "")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(frame(spark, rows), benchmark).collect()}
    assert set(planted) <= got and len(set(changed) - got) <= 1 and not got - set(planted) - set(changed)
    assert decontam.find_leaks(frame(spark, rows).where("false"), benchmark).collect() == []
    assert decontam.find_leaks(frame(spark, rows), benchmark.where("false")).collect() == []


def leaks_of(spark, rows, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(frame(spark, rows), benchmark).collect()}


def test_item_in_most_passages(spark):
    r = random.Random(11)
    items = [(k, prose(24, r)) for k in range(200)]
    rows = [(k, items[0][1]) for k in range(60)] + [(100 + k, prose(40, r)) for k in range(20)] + [(200, prose(8, r) + " " + items[1][1])]
    assert leaks_of(spark, rows, items) == {(k, 0) for k in range(60)} | {(200, 1)}
    few = [(k, items[0][1]) for k in range(8)] + [(100 + k, prose(20, r)) for k in range(12)]
    assert leaks_of(spark, few, items) == {(k, 0) for k in range(8)}


def test_leaks_among_words_outside_the_benchmark(spark):
    r = random.Random(12)
    items = [(k, prose(24, r)) for k in range(100)]
    other = lambda n: [f"out{r.randrange(10**9)}" for _ in range(n)]
    rows, planted = [(5000 + k, " ".join(other(200))) for k in range(20)], set()
    for k, text in items:
        for before in (0, r.randrange(1, 60)):
            words = text.split()
            for x in r.sample(range(24), 5):
                words[x] = other(1)[0]
            planted.add((len(planted), k))
            rows.append((len(planted) - 1, " ".join([*other(before), *words, *other(40)])))
    got = leaks_of(spark, rows, items)
    assert not got - planted and len(planted & got) >= 0.97 * len(planted)


def brute_leaks(rows, items):
    """Every place of every document compared with every item, in plain Python."""
    words = [decontam.words_of(t or "") for _, t in rows]
    texts = [(k, decontam.words_of(t or ""), t or "") for k, t in items]
    terms = {w for _, ws, _ in texts for w in ws}
    df, n = {}, 0
    for ws in words:
        for k in range(0, len(ws), decontam.PASSAGE):
            n += 1
            for w in set(ws[k : k + decontam.PASSAGE]) & terms:
                df[w] = df.get(w, 0) + 1
    idf = {w: max(np.log((n + 1) / (df.get(w, 0) + 1)), 0.1) for w in terms}

    def in_order(item, place):
        best = [(0.0, 0)] * (len(place) + 1)
        count = [0] * (len(place) + 1)
        weight = [0.0] * (len(place) + 1)
        for w in item:
            c0, w0 = count[:], weight[:]
            for k, x in enumerate(place):
                count[k + 1] = max(c0[k + 1], count[k], c0[k] + 1 if x == w else 0)
                weight[k + 1] = max(w0[k + 1], weight[k], w0[k] + idf[w] if x == w else 0)
        return count[-1], weight[-1]

    found = set()
    for (d, _), ws in zip(rows, words, strict=True):
        for i, item, text in texts:
            if not item:
                continue
            if len(item) < decontam.SHORT:
                if ws == item:
                    found.add((d, i))
                continue
            total, own, slack = sum(idf[w] for w in item), set(item), max(4, len(item) // 4)
            last = [decontam.words_of(x) for x in decontam._sentence.split(text)]
            answer = [x for x in last if x][-1]
            for begin in range(-slack, len(ws), 4):
                place = ws[max(0, begin - slack) : max(0, begin + 8 + len(item) + slack)]
                held = [w for w in place if w in own]
                if len(held) < decontam.WORDS * len(item) or sum(idf[w] for w in held) < decontam.WITH_ANSWER * total:
                    continue
                count, weight = in_order(item, place)
                answered = len(answer) >= 3 and any(place[k : k + len(answer)] == answer for k in range(len(place)))
                if count >= decontam.WORDS * len(item) and weight / total >= (decontam.WITH_ANSWER if answered else decontam.ALONE):
                    found.add((d, i))
                    break
    return found


@pytest.mark.parametrize("block", [2_000, 5])
def test_leaks_against_brute_force(spark, monkeypatch, block):
    """Paraphrases of every strength, short items, equal items, long texts; in one block of items and in many."""
    monkeypatch.setattr(decontam, "ITEM_BLOCK", block)
    r = random.Random(31)
    items = [(k, prose(r.choice([8, 14, 24, 40]), r) + ". " + prose(4, r)) for k in range(24)]
    items += [(30, "two words"), (31, prose(5, r)), (32, items[3][1]), (33, None), (34, prose(4, r) + " x"), (None, prose(20, r))]
    rows = [(k, prose(r.choice([3, 60, 300]), r)) for k in range(40)]
    for k, text in items:
        n = len((text or "").split())
        for change in (0, n // 10, n // 5, n // 3, n // 2):
            if text:
                rows.append((100 + len(rows), prose(r.choice([0, 20, 90]), r) + " " + near(text, change, r) + " " + prose(30, r)))
    rows += [(900, prose(9_000, r) + " " + items[5][1] + " " + prose(50, r)), (901, None), (None, items[0][1])]
    rows += [(910, "Two words!"), (911, "two words more"), (912, items[25][1]), (913, "words two")]
    want = brute_leaks(rows, items)
    got = leaks_of(spark, rows, items)
    print(len(want), len(got - want), len(want - got))
    assert len(want) > 60 and len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_a_word_of_the_benchmark_does_not_mark_the_corpus(spark):
    """Items of one to five words leak where they are the whole text alone."""
    rows = [(k, f"the {prose(40)} in the end") for k in range(20)] + [(50, "The."), (51, "in the end"), (52, "in the end of it")]
    assert leaks_of(spark, rows, [(1, "the"), (2, "in the end"), (3, "The"), (4, "")]) == {(50, 1), (50, 3), (51, 2)}


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    r = random.Random(32)
    items = [(k, prose(r.choice([10, 30]), r)) for k in range(23)]
    rows = [(k, prose(60, r)) for k in range(30)] + [(100 + k, prose(10, r) + " " + near(t, 2, r)) for k, t in items]
    found = []
    for block in (2_000, 5):
        monkeypatch.setattr(decontam, "ITEM_BLOCK", block)
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        found.append(sorted((x["doc_id"], x["item_id"], round(x["cosine"], 4), round(x["share"], 6), x["word_from"], x["word_to"]) for x in decontam.find_leaks(frame(spark, rows), benchmark).collect()))
    assert found[0] == found[1] and len(found[0]) >= 22


# 6: HTML
def test_html(spark):
    page = """<html><head><title>t</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav>
    <div class="ad">Buy now.</div><article><h1>A title &amp; more</h1><p>First   paragraph of the story,\n with <b>bold</b> words in it.</p><!-- <p>not</p> --><p>Second paragraph has more of the story.</article>
    <div class="comments"><p>Nice post, thanks!</p></div><footer>© 2023 example.com</footer></body></html>"""
    want = "A title & more\nFirst paragraph of the story, with bold words in it.\nSecond paragraph has more of the story."
    rows = [(1, "u", page), (2, None, None), (None, "u", ""), (3, "u", page), (3, "u", page), (4, "u", "<article><p>" + "word " * 50_000 + "</p></article>"), (5, "u", "<p>open <b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert [r["text"] for r in got if r["page_id"] in (1, 3)] == [want] * 3
    assert {r["text"] for r in got if r["page_id"] in (2, None)} == {""}
    assert next(r for r in got if r["page_id"] == 4)["n_chars"] == 5 * 50_000 - 1
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(df.where("false")).collect() == []


def test_elements_that_hide_nothing():
    def texts(page):
        return [text for _, text, _ in html_extract.blocks(page)]

    for tag in ('<svg class="i" viewBox="0 0 1 1"/>', "<svg/>", "<math/>", "<svg>", "<noscript>", "<math>", "<object>", "<select>", "<template>"):
        for tail in ("", "<p>Two</p><svg><text>no</text></svg><noscript>no</noscript><select><option>no</select><template>no</template>"):
            assert texts(f"<p>One</p>{tag}<p>more</p>{tail}") == ["One", "more", *(["Two"] if tail else [])], tag
    assert texts('<p>An <svg class="i" /> icon</p>') == ["An icon"]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p><p>An <object data='a'>old text</object> here</p>") == ["Let x=1 be", "An old text here"]
    for tag in ("script", "style", "textarea", "title", "iframe", "noscript", "svg", "select", "template"):
        assert texts(f"<p>One</p><{tag} a='>'>no <b>no</b></{tag.upper()} ><p>Two</p>") == ["One", "Two"], tag
    for tag in ("script", "style", "textarea", "title", "iframe"):
        assert texts(f"<p>One</p><{tag}>no <b>no</b>") == ["One"], tag
    for tag in ("svg", "template"):
        assert texts(f"<p>One</p><{tag}>no<{tag}>no</{tag}>no</{tag}><p>Two</p>") == ["One", "Two"], tag


def test_deep_nesting_is_linear():
    """Unclosed elements by the thousands, closing tags without an opening one, inline elements in the way of block ones."""
    began, n = time.perf_counter(), 50_000
    deep = html_extract.blocks("<div class='x'>t" * n)
    assert len(deep) == n and deep[-1][0] == (deep[0][0][0], 2 * n)
    assert html_extract.blocks("<div>" * n + "</span></em></p>" * n + "t")[0][1] == "t"
    assert len(html_extract.blocks("<b>" * n + "<p>t" * n)) == n and len(html_extract.blocks("<li>t" * n + "</ul>" * n)) == n
    assert time.perf_counter() - began < 60
    nested = html_extract.blocks("<div id=main><p class=lead>A<b>b</b></p><p>C</p></div>D")
    assert [(text, path[1]) for path, text, _ in nested] == [("Ab", 4), ("C", 3), ("D", 0)]


#: Pages written by hand, of other make than the trained ones: what they hold of main text, and of other parts.
LAYOUTS = {
    "tables": (
        """<html><body bgcolor="#fff"><table width="780" cellpadding="2"><tr><td colspan="2"><img src="logo.gif"><font size="5">Garden Club</font></td></tr>
        <tr><td width="130"><a href="i.html">Index</a><br><a href="f.html">Forum</a><br><a href="s.html">Shop</a><br><a href="l.html">Links</a></td>
        <td><p><b>Pruning the old apple trees</b></p><p>Begin in late winter, when the buds still sleep. Take out the dead wood first, then the branches that rub against each other.</p>
        <p>Stand back after every third cut and look at the whole tree. It is easy to take too much, and the tree answers with a thicket of shoots.</p>
        <p>Old cuts that have not healed should be left alone unless they rot.</p></td></tr>
        <tr><td colspan="2" align="center">Copyright 2003 Garden Club. All rights reserved.</td></tr></table></body></html>""",
        ["Begin in late winter", "Stand back after every", "Old cuts that have"],
        ["Index", "Forum", "Shop", "All rights reserved"],
    ),
    "div soup": (
        """<html><body><div><div><div><a href="/">Harbour Herald</a></div><div><a href="/l">Local</a> <a href="/s">Sport</a> <a href="/w">Weather</a> <a href="/j">Jobs</a></div></div>
        <div><div><h1>Ferry returns after two years of repairs</h1><div>The ferry to the north shore sails again from Monday, the town council said after its meeting on Thursday evening.</div>
        <div>Repairs took far longer than planned, because parts of the hull had to be made anew. The cost rose to nearly twice the first estimate.</div>
        <div>Tickets stay at their old price until the end of the summer.</div></div></div>
        <div class="footer"><div><a href="/a">About us</a> <a href="/c">Contact</a> <a href="/p">Privacy</a></div><div>Copyright 2019 Harbour Herald</div></div></div></body></html>""",
        ["Ferry returns", "sails again from Monday", "Repairs took far longer", "Tickets stay at"],
        ["Weather", "Privacy", "Copyright"],
    ),
    "documentation": (
        """<html><body><header class="topbar"><a href="/">queuelib</a><form role="search"><input placeholder="Search"><button>Search</button></form></header>
        <div class="layout"><nav class="sidebar-tree"><ul><li><a href="#">Installation</a></li><li><a href="#">Quick start</a></li><li><a href="#">Workers</a><ul><li><a href="#">Retries</a></li></ul></li></ul></nav>
        <main class="markdown-body"><h1>Workers</h1><p>A worker takes jobs from one or more queues and runs them in order of their priority.</p><pre><code>worker.run(queues=["mail"])</code></pre>
        <h2>Retries</h2><p>A job that fails is put back with a delay that doubles each time, up to the limit that the queue was made with.</p><ul><li>The first delay is one second.</li><li>The last is ten minutes.</li></ul></main></div>
        <footer>Built with sphinx. <a href="#">Edit this page</a></footer></body></html>""",
        ["A worker takes jobs", "worker.run(", "A job that fails", "The first delay", "The last is ten"],
        ["Installation", "Quick start", "Edit this page"],
    ),
    "forum": (
        """<html><body><div id="nav"><a href="/">Board</a> | <a href="/m">Members</a> | <a href="/h">Help</a></div>
        <div class="post question"><h2>Pump loses its prime overnight</h2><p>Our well pump has to be primed every morning since we changed the foot valve. The pressure gauge falls to nothing within about two hours.</p>
        <p>I have checked the pipe above the ground for leaks and found none. What should I look at next?</p></div>
        <div class="replies"><div class="reply"><p>Had the same thing last year, it was the valve seat.</p></div><div class="reply"><p>Check the seal of the lid too!</p></div></div>
        <form class="reply-form"><textarea>Your answer</textarea><button>Post reply</button></form><div class="footer">Powered by BoardWare</div></body></html>""",
        ["Pump loses its prime", "has to be primed every morning", "I have checked the pipe"],
        ["Members", "valve seat", "seal of the lid", "Post reply", "Powered by"],
    ),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts_made_by_hand(layout):
    page, main, other = LAYOUTS[layout]
    text = html_extract.extract_text([page], html_extract.train())[0]
    assert len([x for x in main if x not in text]) + len([x for x in other if x in text]) <= 1, text  # at most one block is wrong


def test_labeller_on_pages_it_has_not_seen():
    model, r = html_extract.train(), random.Random(99)
    right = total = 0
    for _ in range(150):
        x, y = html_extract.labelled(html_extract.make_page(r))
        if len(x):
            found = model.logits(x[None], np.ones((1, len(x)), np.float32))[0] > 0
            right, total = right + int((found == (y > 0)).sum()), total + len(y)
    assert right / total > 0.95


# 8: n-gram join
def brute_texts(rows):
    def grams(t):
        w = (t or "").lower().split()
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in rows]
    return [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]


def groups_of_rows(part):
    out = {}
    for k, p in part.items():
        out.setdefault(p, []).append(k)
    return out.values()


def test_a_null_id_shares_a_text_with_an_id(spark):
    texts = {"a": prose(30), "b": prose(30)}
    rows = [(None, texts["a"]), (4, texts["a"]), (None, texts["a"]), (None, texts["b"]), (None, texts["b"]), (9, near(texts["a"], 0) + " x")]
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in ngram_join.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(4, 4, 3, True), (9, 4, 3, False), *[(None, 4, 3, False)] * 2, *[(None, None, 1, True)] * 2], key=str)
    assert sorted((r["doc_id"] for r in ngram_join.keep_one(frame(spark, rows)).collect()), key=str) == [4, None]


def test_columns_of_inner_names_and_ties_in_keep_one(spark):
    text = prose(30)
    rows = [(4, text, "p", 1, "q", 2), (4, text, "r", 1, "q", 2), (7, text + " x", "s", 1, "q", 2), (4, text + " y", "t", 1, "q", 2), (8, prose(30), "u", 1, "q", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id string, gone_key int, _key string, row int")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 8]


@pytest.mark.parametrize("target", [ngram_join.TARGET, 1.0])
def test_links_near_the_threshold(spark, target):
    """Among texts of which many pairs stand just at the threshold, the forest finds at least 0.99 of the brute-force links and the
    exact way all."""
    r = random.Random(21)
    base = [prose(60, r) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + 10 * k + j, near(t, r.choice([1, 1, 2, 2]), r)) for k, t in enumerate(base) for j in range(4)] + [(5000 + k, prose(60, r)) for k in range(300)]
    links = brute_texts(rows)
    got = {x["doc_id"]: x for x in ngram_join.near_duplicates(frame(spark, rows), target=target).collect()}
    part = roots(range(len(rows)), links)
    want = {rows[k][0]: sum(k in p for p in links) for k in range(len(rows))}
    assert len(links) > 100 and len(got) == len(rows)
    found = sum(x["n_links"] for x in got.values()) / 2
    assert 0.99 * len(links) <= found <= len(links)
    if target == 1.0:
        assert {d: x["n_links"] for d, x in got.items()} == want
        assert {d: x["class_id"] for d, x in got.items()} == {rows[k][0]: rows[p][0] for k, p in part.items()}


def trace(spark, rows):
    """What link_classes() tells of its steps over these texts, and its classes as sets of texts."""
    signed = ngram_join.sign(frame(spark, rows)).where("node IS NOT NULL").select("doc_id", "node", "sig").cache()
    texts = signed.join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").select("node", "text")
    classes, _, steps = ngram_join.link_classes(signed.select("node", "sig"), lambda nodes: texts.join(nodes, "node", "left_semi"))
    return steps, {frozenset(r["ids"]) for r in signed.join(classes, "node").groupBy("component").agg(F.collect_list("doc_id").alias("ids")).collect()}


def test_prefixes_are_shortened_step_by_step(spark):
    """Near copies far from the threshold end the search before the shortest prefix; links near it lead down to that by steps."""
    r = random.Random(4)
    base = [prose(400, r) for _ in range(30)]
    far = [(k, t) for k, t in enumerate(base)] + [(100 + k, near(t, 1, r)) for k, t in enumerate(base)]
    steps, classes = trace(spark, far)
    floor = ngram_join.depth_for(ngram_join.THRESHOLD, ngram_join.TARGET)
    assert [d for d, _, _ in steps] == list(range(ngram_join.DEPTH, steps[-1][0] - 1, -ngram_join.STEP)) and steps[-1][0] > floor
    assert steps[-1][1] == 0 and steps[-1][2] >= ngram_join.TARGET
    assert classes == {frozenset((k, 100 + k)) for k in range(30)}
    base = [prose(50, r) for _ in range(40)]  # a changed word leaves 41 of 51 shingles
    close = [(k, t) for k, t in enumerate(base)] + [(100 + 10 * k + j, near(t, 1, r)) for k, t in enumerate(base) for j in range(4)]
    steps, classes = trace(spark, close)
    assert [d for d, _, _ in steps] == [*range(ngram_join.DEPTH, floor, -ngram_join.STEP), floor]
    assert all(least < ngram_join.TARGET or n for _, n, least in steps[:-1])
    part = roots(range(len(close)), brute_texts(close))
    assert classes == {frozenset(close[k][0] for k in g) for g in groups_of_rows(part) if len(g) > 1}


def test_tries_over_batches(spark, monkeypatch):
    """Longest common prefixes and branches are those of the sorted signatures, wherever batches and partitions end."""
    r = random.Random(6)
    nodes = [(bytes([k // 256, k % 256]), np.array([[r.choice([1, 2]) for _ in range(ngram_join.DEPTH)] for _ in range(ngram_join.TREES)], ">u4").tobytes()) for k in range(300)]
    want = {}
    depth = 4
    for tree in range(ngram_join.TREES):
        rows = sorted((sig[tree * 32 : tree * 32 + 32], node) for node, sig in nodes)
        shared = lambda a, b: next((k for k in range(8) if a[4 * k : 4 * k + 4] != b[4 * k : 4 * k + 4]), 8)
        for k, (sig, node) in enumerate(rows):
            back = shared(rows[k - 1][0], sig) if k else 0
            ahead = shared(sig, rows[k + 1][0]) if k + 1 < len(rows) else 0
            if back >= depth:
                j = k
                while j and shared(rows[j - 1][0], sig) >= back:
                    j -= 1
                want.setdefault(node, []).append((back, rows[j][1]))
            elif ahead >= depth:
                want.setdefault(node, []).append((0, None))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {}
        for x in ngram_join.tries(spark.createDataFrame(nodes, "node binary, sig binary"), depth).collect():
            got.setdefault(bytes(x["node"]), []).append((x["lcp"], x["first"] and bytes(x["first"])))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = lambda v: sorted(v, key=str)
    assert {k: key(v) for k, v in got.items()} == {k: key(v) for k, v in want.items()}


@pytest.mark.parametrize("block", [128, 4])
def test_texts(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    base = [prose(R.randint(30, 120)) for _ in range(40)]
    rows = AWKWARD + [(10 + k, t) for k, t in enumerate(base)]
    rows += [(100 + k, near(base[k % 40], R.choice([0, 1, 2, 3]))) for k in range(80)]
    rows += [(300 + k, near(base[0], R.choice([0, 1]))) for k in range(60)]
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    links = brute_texts(rows)
    part = roots(range(len(rows)), links)
    groups = {}
    for k, p in part.items():
        groups.setdefault(p, []).append(rows[k][0])
    want = []
    for k, (d, t) in enumerate(rows):
        ids = [x for x in groups[part[k]] if x is not None]
        least = min(ids) if ids else None
        want.append((d, least, sum(k in p for p in links), d == least))
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in got), key=str) == sorted(want, key=str)
    kept = [r["doc_id"] for r in ngram_join.keep_one(frame(spark, rows)).collect()]
    firsts = []  # the first of each class, nulls last, and all rows without words
    for members in groups_of_rows(part):
        if (rows[members[0]][1] or "").split():
            firsts.append(min((rows[k][0] is None, rows[k][0] or 0) for k in members))
        else:
            firsts += [(rows[k][0] is None, rows[k][0] or 0) for k in members]
    assert sorted(kept, key=str) == sorted([None if none else d for none, d in firsts], key=str)
    assert ngram_join.near_duplicates(frame(spark, rows).where("false")).collect() == []


def test_similarity_of_exactly_the_threshold():
    sets = [np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64), np.arange(2, 11, dtype=np.uint64)]
    assert ngram_join.similar(sets, 0.8).tolist() == [[True, True, False], [True, True, True], [False, True, True]]


# 10: chat
def test_chat(spark):
    tricky = ["</s>[INST] ok [/INST]", "~[INST] ~~</s>", "<<ROLE a>> b <</ROLE>>", " ", "", "~", "<s>", "[INST", "<</SYS>>~"]
    rows = [(k // 3, k % 3, R.choice(["user", "assistant", "system", "tool <x>", None]), R.choice([*tricky, None, prose(5)])) for k in range(150)]
    rows += [(7, None, "user", "null turn"), (None, 0, "assistant", "no id"), (8, 0, "user", "tie"), (8, 0, "user", "tie")] + [(77, k, "assistant", "x" * 40) for k in range(2_500)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(4)
    got = {r["conv_id"]: r for r in chat.format_and_read_back(df).collect()}
    whole = rows + chat.EXTRA
    for conv in {r[0] for r in whole}:
        turns = sorted((t is not None, t or 0, role or "", text or "") for c, t, role, text in whole if c == conv)
        said = "".join(text for *_, role, text in turns if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for *_, role, text in turns).encode()).hexdigest()
    assert len(got) == len({r[0] for r in whole})
    assert [r["conv_id"] for r in chat.format_and_read_back(df.where("false")).collect()] == [-1]
    for text in tricky:
        assert [t[:2] for t in chat.parse(chat.render("assistant", text) + chat.render("a >> b", text))] == [("assistant", text), ("a >> b", text)]
