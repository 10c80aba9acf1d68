"""The index search against sums over all pairs."""

import random
import re
from collections import Counter, defaultdict
from math import log, sqrt

import pytest
from pyspark.sql import functions as F

from linkloom.operators import retrieval, sparse


def brute(queries, docs, k, most=10):
    """Of rows (id, text): ids that repeat are one text, n counts rows."""

    def counts(rows):
        out = defaultdict(Counter)
        for i, t in rows:
            out[i].update(x for x in re.findall(r"[^\W_]+", (t or "").lower()) if len(x) >= 2)
        return out

    q, d = counts(queries), counts(docs)
    df = Counter(t for c in d.values() for t in c)
    idf = {t: log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items() if 2 <= n <= max(0.01 * len(docs), most)}

    def weights(c):
        w = {t: (1 + log(n)) * idf[t] for t, n in c.items() if t in idf}
        z = sqrt(sum(x * x for x in w.values()))
        return {t: x / z for t, x in w.items()}

    q, d, out = {i: weights(c) for i, c in q.items()}, {i: weights(c) for i, c in d.items()}, set()
    for i, a in q.items():
        found = sorted((-s, j) for j, b in d.items() if (s := round(sum(x * b[t] for t, x in a.items() if t in b), 9)) > 0)[:k]
        out |= {(i, j, -s, r) for r, (s, j) in enumerate(found, 1)}
    return out


def texts(n, seed):
    rnd = random.Random(seed)
    rows = [" ".join(rnd.choices([f"w{i}" for i in range(60)], k=rnd.randrange(9))) for _ in range(n)]
    return rows + ["w1 w2 w3"] * 15 + ["", None, "x", "Ünï ünï cöde w7"]


def search(spark, queries, docs, k, most=10):
    q, d = (spark.createDataFrame(x, "id string, text string").repartition(3) for x in (queries, docs))
    got = retrieval.tfidf_topk(q, "id", F.col("text"), d, "id", F.col("text"), k, least_max_df=most)
    return {(r["query_id"], r["cand_id"], round(r["score"], 8), r["rank"]) for r in got.collect()}


def close(rows):
    return {(i, j, round(s, 8), r) for i, j, s, r in rows}


@pytest.fixture
def small(monkeypatch):
    """Pieces so small that each has its edges; the session's workers see them too, as what they run is made here."""
    for name, value in {"TOKENS": 16, "POSTINGS": 40, "QUERIES": 7, "CELLS": 30}.items():
        monkeypatch.setattr(sparse, name, value)


@pytest.mark.parametrize("k", [1, 4, 50])
def test_topk_is_that_of_all_pairs(spark, k):
    queries, docs = [(f"q{i}", t) for i, t in enumerate(texts(40, 1))], [(f"d{i}", t) for i, t in enumerate(texts(150, 2))]
    assert search(spark, queries, docs, k, 60) == close(brute(queries, docs, k, 60))


def test_no_pair_or_posting_is_shuffled(spark):
    """Candidates came from a join on terms, whose pairs were shuffled."""
    rows = spark.createDataFrame([(f"d{i}", "alpha beta") for i in range(6)], "id string, text string")
    plan = retrieval.tfidf_topk(rows, "id", F.col("text"), rows, "id", F.col("text"), 3)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "MapInArrow" in plan


def test_repeated_ids_are_one_text(spark):
    queries = [("q", "alpha beta"), ("q", "gamma"), ("r", "beta")]
    docs = [("a", "alpha"), ("a", "beta gamma"), ("b", "beta beta"), ("c", "alpha gamma"), ("c", "gamma")]
    assert search(spark, queries, docs, 5) == close(brute(queries, docs, 5))


def test_nothing_known(spark):
    assert search(spark, [("q", "zz")], [("a", "alpha"), ("b", None)], 5) == set()


def test_terms_of_one_hash_get_another_seed(spark, monkeypatch):
    seen = []

    def weak(term, seed):
        seen.append(seed)
        return F.xxhash64(F.lit(seed), term if seed else F.length(term))

    monkeypatch.setattr(sparse, "hashed", weak)
    queries, docs = [("q", "aa bb")], [("a", "aa"), ("b", "aa bb"), ("c", "bb cc"), ("d", "cc")]
    assert search(spark, queries, docs, 5) == close(brute(queries, docs, 5)) and max(seen) == 1


def test_blocks_and_pieces_of_any_size(small, tmp_path):
    """Postings written in many blocks and searched a few queries at a time: what tasks do, here in one process."""
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    h = np.sort(rnd.integers(0, 2**64, 40, np.uint64))
    part = h >> np.uint64(64 - sparse.PARTS_BITS)
    sizes = {int(b): int((part == b).sum()) for b in np.unique(part)}
    folder = str(tmp_path)
    for b in sizes:
        sparse.save(folder, f"terms-{b}", {"h": h[part == b], "idf": 1 + np.arange(int((part == b).sum())) / 7})
    rows = [h[rnd.integers(0, 40, rnd.integers(0, 12))] for _ in range(90)]
    batch = lambda some: pa.record_batch([pa.array([f"d{i}" for i in some]), pa.array([rows[i].view(np.int64).tolist() for i in some], pa.list_(pa.int64()))], names=["id", "terms"])
    names = [b.column(0)[0].as_py() for n in (range(50), range(50, 90)) for b in sparse._indexer(folder, sizes)([batch(n)])]
    assert len(names) > 5
    schema = pa.schema([("query_id", pa.string()), ("cand_id", pa.string()), ("score", pa.float64()), ("rank", pa.int64())])
    got = pa.Table.from_batches(sparse._searcher(folder, sizes, names, 5, schema)([batch(range(60)), batch(range(60, 90))])).to_pylist()
    words = sparse._Vocabulary(folder, sizes)
    dense = np.zeros((90, 40))
    for i, r in enumerate(rows):
        _, term, w = words.weigh(r, np.zeros(len(r), np.int64), 1)
        dense[i, term] = w
    score = np.round(dense @ dense.T, 9)
    want = {(f"d{i}", j, float(s), n) for i in range(90) for n, (s, j) in enumerate(sorted((-score[i, j], f"d{j}") for j in range(90) if score[i, j] > 0)[:5], 1)}
    assert {(r["query_id"], r["cand_id"], round(r["score"], 8), r["rank"]) for r in got} == {(i, j, round(-s, 8), n) for i, j, s, n in want}
