"""Exact dedup, ranked search and token alignment against brute force, and on awkward rows."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from klaxon.llm import cuckoo_dedup, impact_index, token_align

from test_corpus_operators import AWKWARD, R, frame, near, prose


# 11: exact dedup
def brute_exact(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[hashlib.sha256(bare.encode()).hexdigest()].append((-len(text or ""), doc_id is None, doc_id or 0))
    out = collections.Counter()
    for key, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        for k, m in enumerate(sorted(members)):
            out[(None if m[1] else m[2], keep, len(members), k == 0, key)] += 1
    return out


def exact_rows():
    texts = [prose(R.randint(0, 12)) for _ in range(150)]
    rows = [(k, R.choice(texts)) for k in range(1000, 1400)] + [(k, R.choice(texts).replace(" ", R.choice(["  ", "\n", "\t\x0b", ""]))) for k in range(2000, 2200)]
    return [*rows, *AWKWARD, (90, "\x1c"), (91, "\xa0"), (92, " \r\n\t\x0b\x0c"), *[(k, "hot text") for k in range(3000, 3400)]]


def test_exact_duplicates_against_brute_force(spark):
    rows = exact_rows()
    got = cuckoo_dedup.exact_duplicates(frame(spark, rows))
    assert collections.Counter(map(tuple, got.collect())) == brute_exact(rows)
    assert cuckoo_dedup.exact_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_cuckoo_filter_overflows_and_resizes():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    small = cuckoo_dedup.CuckooFilter(5)
    assert small.insert(keys[:100]) and small.holds(keys[:100]).all()
    assert not small.insert(keys[100:200])  # 128 places
    e = np.zeros(3000, cuckoo_dedup.ENTRY)
    e["w0"], e["n"] = keys, 1
    shard = cuckoo_dedup.Shard(np.zeros(0, cuckoo_dedup.ENTRY))
    for k in range(0, 3000, 250):
        shard.insert(cuckoo_dedup.folded(e[k : k + 250]))
    assert len(shard.stored) == 3000 and shard.filter.holds(keys).all() and shard.filter.bits >= 10
    assert (shard.filter.table != 0).sum() == 3000
    shard.delete(e[:1000])
    assert len(shard.stored) == 2000 and (shard.filter.table != 0).sum() == 2000 and (shard.find(e[1000:]) >= 0).all() and (shard.find(e[:1000]) < 0).all()


def test_false_hits_are_verified():
    """Keys of one bucket and one fingerprint are told apart by the stored digests."""
    e = np.zeros(3, cuckoo_dedup.ENTRY)
    e["w0"], e["w1"], e["n"] = 7, [1, 2, 3], 1
    shard = cuckoo_dedup.Shard(np.zeros(0, cuckoo_dedup.ENTRY))
    shard.insert(e[:2])
    assert shard.filter.holds(e["w0"]).all() and (shard.find(e) >= 0).tolist() == [True, True, False]


def test_cuckoo_index_over_versions(spark, tmp_path):
    rows = exact_rows()
    first, second = frame(spark, rows[:300]), frame(spark, rows[300:])
    index = cuckoo_dedup.CuckooIndex(spark, f"file://{tmp_path}/index", per_shard=60)
    a, b = cuckoo_dedup.digests(first), cuckoo_dedup.digests(second)
    index.insert(a)
    shards = index.state()[1]
    index.insert(b)
    assert index.state()[1] > shards > 1
    want = {(bytes.fromhex(k[4]), k[2], k[1]) for k in brute_exact(rows)}
    assert {(bytes(r["key"]), r["group_size"], r["keep_id"]) for r in index.live().collect()} == want
    asked = cuckoo_dedup.digests(frame(spark, [(1, "never seen"), (2, "hot\ttext")]))
    assert [r["group_size"] for r in index.ask(asked).collect()] == [400]
    index.delete(b)
    gone = {bytes(r[0]) for r in b.select("digest").collect()}
    assert {bytes(r["key"]) for r in index.live().collect()} == {k for k, _, _ in want if k not in gone}
    assert index.ask(b).count() == 0
    index.insert(b)  # deleted digests are new again
    assert {bytes(r["key"]) for r in index.live().collect()} == {k for k, _, _ in want}


# 12: ranked search
def brute_ranks(rows, items):
    terms = lambda t: re.findall(impact_index.TERM, (t or "").translate(str.maketrans(impact_index.UPPER, impact_index.LOWER)))
    docs = [(i, collections.Counter(terms(t))) for i, t in rows]
    filled, total = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * filled + 2) / (2 * n + 1))) for t, n in df.items()}
    out = collections.Counter()
    for item, text in set(items):
        scores = []
        for doc_id, c in docs:
            m = 25 + (75 * c.total() * filled) // max(1, total)
            scores.append((-sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t]), doc_id is None, doc_id or 0))
        for k, (score, null, doc_id) in enumerate(sorted(s for s in scores if s[0] < 0)[:10]):
            out[item, k + 1, None if null else doc_id, -score] += 1
    return out


@pytest.mark.parametrize("block", [5, 64, 65_536])
def test_ranks_against_brute_force(spark, block):
    rows = [(k, prose(R.randint(1, 60))) for k in range(100, 260)]
    rows += [(k, near(rows[0][1], 1)) for k in range(300, 303)] + [(k, rows[5][1]) for k in (7, 400, 401)] + [(50, "Straße, ÉCOLE \U0001f600 x y école"), *AWKWARD]
    items = [(1, rows[0][1]), (2, rows[5][1].upper() + " " + rows[5][1]), (2, "école"), (3, None), (4, ""), (5, "same same SAME text"), (5, "same same SAME text"), (6, "nowhere-found"), (None, "long no id"), (7, "\U0001f600 x y")]
    frame_of = spark.createDataFrame([(i, t, 1, "b") for i, t in items], "item_id long, text string, doc_id int, block string")
    got = impact_index.search(*impact_index.build(frame(spark, rows), block=block), frame_of, chunk=3)
    assert collections.Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == brute_ranks(rows, items)


def test_ranks_of_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert impact_index.rank_documents(docs.limit(0), items).count() == 0
    assert impact_index.rank_documents(docs, items.limit(0)).count() == 0


def test_carry_and_descent():
    rng = np.random.default_rng(1)
    ids, nulls = rng.permutation(256), np.zeros(256, np.uint8)
    for _ in range(20):
        total, sums = np.zeros((63, 4), np.uint64), np.zeros(256, np.int64)
        for _ in range(rng.integers(1, 30)):
            places = np.sort(rng.choice(256, rng.integers(1, 200), replace=False))
            values = rng.integers(1, [4, 2**33][rng.integers(2)], len(places))
            words = np.unique(places >> 6)
            impact_index.added(total, words, impact_index.weighted(places, words, values))
            sums[places] += values
        want = sorted((-s, ids[p]) for p, s in enumerate(sums) if s)[:10]
        assert sorted((-s, ids[p]) for p, s in impact_index.best(total, 10, ids, nulls)) == want


# 13: alignment
def brute_alignment(rows):
    pair = token_align.tokenizers(*token_align.default_paths())
    found, counts = [], collections.Counter()
    for doc_id, text in rows:
        a, b = (pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)) if text else ([], [])
        spelled = [b"".join(map(t.__getitem__, x)) for t, x in ((pair.a_bytes, a), (pair.b_bytes, b))]
        if not text or any(s != (" " + text).encode() for s in spelled):
            found.append((doc_id, None))
            continue
        spans = [[], []]
        for k, (tokens, ids) in enumerate(((pair.a_bytes, a), (pair.b_bytes, b))):
            at = 0
            for i in ids:
                spans[k].append((at, at + len(tokens[i]), i))
                at += len(tokens[i])
        links, j = [], 0
        for low, high, i in spans[0]:
            while spans[1][j][1] <= low:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < high:
                links.append((i, spans[1][k][2]))
                k += 1
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, p, q = [], 0, 0
        for end in both:
            x, y = p, q
            while p < len(spans[0]) and spans[0][p][1] <= end:
                p += 1
            while q < len(spans[1]) and spans[1][q][1] <= end:
                q += 1
            groups.append(",".join(str(s[2]) for s in spans[0][x:p]) + "|" + ",".join(str(s[2]) for s in spans[1][y:q]))
        counts.update(links)
        found.append((doc_id, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return collections.Counter((i, *((0,) * 6), "") if x is None else (i, *x[:3], len(x[3]), sum(counts[p] == best[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) for i, x in found)


def odd_text(k):
    parts = ["word", " ", "  ", "\n", "\t", "\r\n", "<|endoftext|>", "<s>", "</s>", "<0x41>", "don't", "1234", "Straße", "中文字", "́", "\xa0", " ", "\x85", "\x1c", "​", "\U0001f600", "ﬁ", "...", "\x00", "é", "()", "_"]
    return "".join(R.choice(parts) for _ in range(k))


@pytest.mark.parametrize(("block_chars", "pairs"), [(token_align.BLOCK_CHARS, token_align.PAIRS), (500, 0)])
def test_alignment_against_brute_force(spark, block_chars, pairs):
    rows = [(k, odd_text(R.randint(1, 40))) for k in range(400, 550)] + [(k, prose(60)) for k in range(600, 640)] + [(700, "a ▁ b"), (701, "▁"), (702, " "), (703, "   "), (704, "end "), (705, "x" * 3000), *AWKWARD]
    got = token_align.align_documents(frame(spark, rows), block_chars=block_chars, pairs=pairs)
    assert collections.Counter(map(tuple, got.collect())) == brute_alignment(rows)


def test_alignment_of_an_empty_table(spark):
    assert token_align.align_documents(frame(spark, [(1, "a b")]).limit(0)).count() == 0


def test_no_token_lies_across_a_cut():
    """Every text is cut where both tokenizers end a token, whatever stands around the space."""
    pair = token_align.tokenizers(*token_align.default_paths())
    for k in range(300):
        text = odd_text(R.randint(2, 30))
        if pair.spells(text):
            a, b = pair.encode(pair.cuts.split(text))
            assert [i for x in a for i in x] == pair.a.encode(" " + text, add_special_tokens=False).ids
            assert [i for x in b for i in x] == pair.b.encode(text)
