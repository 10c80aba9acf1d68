"""Toxicity by the nearest labelled examples: exact TF-IDF cosine through a block-max inverted index.

The labelled examples are a bounded sample of documents (LEARN_ROWS by a hash of id and text; a documented bound); all their words are
terms, weighted by 1 + ln(count) and by idf over the examples, each example a unit vector. A text is searched in passages: its
distinct words in the order in which they come first, PASSAGE at a time to its end, each with its count in the whole text. A few
words decide, and in one vector of a long text they would drown. The index keeps the postings of rare terms, and for frequent terms
rows of weights in blocks of BLOCK example numbers with each block's largest weight; examples of one language stand together, those of few
words and so of large weights first. A passage's rare terms are added up first; a block's bound is its best sum so far and the frequent
terms' largest weights there, and the frequent terms are added from the first to the last block whose bound reaches the
NEIGHBOURS-th best sum so far, so the nearest are exact. Many passages are searched at once with numpy.
Votes weighted by cosine give a passage's share of toxic neighbours, the mean of a text's two highest shares is the text's, and a
logistic curve fitted on the examples themselves, each searched without itself and its copies, calibrates it. Evidence: the
nearest examples of the passage of highest share. Texts without any word of the examples get the share of toxic examples.

Broadcast: the examples' postings, at most LEARN_ROWS vectors, whatever the corpus.

Defined results: null, empty and word-less texts get the share of toxic examples and no evidence; without usable labels (or with
an empty table of labels) every score is 0.0; an empty table of documents gives no rows; contradicting labels of an id
are left out; an id with two texts is two examples, a repeated row one; repeated rows are scored one by one and alike; equal cosines are
settled by example number; texts are read whole; columns of the documents other than doc_id and
text aren't read, and `stage` hands them on as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import lean, table, written

#: Examples, at most: the bound of the sample that is learned from.
LEARN_ROWS = 3_000
PASSAGE = 8
NEIGHBOURS = 25
BLOCK = 64
#: Terms in more than one of so many examples are kept as whole rows of weights; rows that are sparser take longer to read than their postings.
OFTEN = 4
#: Examples in a part, of whose largest cosines the k-th is a bound for the k-th best.
PARTED = 16
#: Weight of the prior among the votes, as of a cosine.
PRIOR = 0.1
#: Passages that are searched at once.
BATCH = 128
FOLDS = 5
#: Texts whose result a worker remembers, for copies.
CACHE = 50_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    out = np.repeat(start - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


class Index:
    """Examples' unit vectors as blocked postings. examples: (id, toxic, digest of the text, words with their counts)."""

    def __init__(self, examples: Iterable[tuple[int, int, bytes, list[str], list[int]]]):
        examples = list(examples)
        df = Counter(w for e in examples for w in e[3])
        # by the most widespread word, which tells languages apart, then short ones first
        order = sorted(examples, key=lambda e: (max(e[3], key=lambda w: (df[w], w), default=""), len(e[3]), e[0], e[2]))
        n = len(order)
        self.ids, self.toxic = np.array([e[0] for e in order], np.int64), np.array([e[1] for e in order], float)
        digests = {d: k for k, d in enumerate(sorted({e[2] for e in order}))}
        self.copy_of, self.copies = np.array([digests[e[2]] for e in order], np.int64), digests
        self.term = {w: k for k, w in enumerate(sorted(df))}
        self.idf = np.array([math.log((1 + n) / (1 + df[w])) + 1 for w in self.term])
        sizes = np.array([len(e[3]) for e in order], np.int64)
        number = np.repeat(np.arange(n), sizes)
        term = np.fromiter((self.term[w] for e in order for w in e[3]), np.int64, sizes.sum())
        weight = (1 + np.log(np.fromiter((c for e in order for c in e[4]), float, sizes.sum()))) * self.idf[term]
        weight /= np.sqrt(np.bincount(number, weight * weight, n))[number]
        by = np.lexsort((number, term))
        self.number, self.weight = number[by].astype(np.int32), weight[by]
        term = term[by]
        self.blocks = max(1, -(-n // BLOCK))
        self.at = np.searchsorted(term, np.arange(len(self.term) + 1))
        # the frequent terms' postings as whole rows of weights, and the largest weight in each block of a row
        often = np.flatnonzero(np.diff(self.at) > max(1, n // OFTEN))
        self.row = np.full(len(self.term), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.blocks * BLOCK))
        mine = self.row[term]
        self.rows[mine[mine >= 0], self.number[mine >= 0]] = self.weight[mine >= 0]
        self.most = self.rows.reshape(len(often), self.blocks, BLOCK).max(axis=2)
        self.copy_in = np.r_[self.copy_of, np.full(self.blocks * BLOCK - n, -2)].reshape(-1, BLOCK)
        self.prior = float((self.toxic.sum() + 0.5) / (n + 1)) if n else 0.0
        self.curve = (1.0, 0.0)

    def passages(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, term, weight) of a text's known words; the weights of a passage form a unit vector. Unknown words take their places, too."""
        counts = Counter(words)
        term = np.fromiter(map(self.term.get, counts, repeat(-1)), np.int64, len(counts))
        known = np.flatnonzero(term >= 0)
        who, term = known // PASSAGE, term[known]
        x = (1 + np.log(np.fromiter(counts.values(), np.int64, len(counts))[known])) * self.idf[term]
        return who, term, x / np.sqrt(np.bincount(who, x * x))[who] if len(who) else x

    def nearest(self, who: np.ndarray, term: np.ndarray, x: np.ndarray, n: int, k: int = NEIGHBOURS, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, number, cosine) of the k nearest examples with any common term for each of n queries, best first; ties by number.

        but: for each query the text (an entry of copy_of) whose copies don't count, or -1.
        """
        row, width = self.row[term], self.blocks * BLOCK
        # the rare terms, posting by posting
        mine = np.flatnonzero(row < 0)
        size = self.at[term[mine] + 1] - self.at[term[mine]]
        post = _ranges(self.at[term[mine]], size)
        cell, product = np.repeat(who[mine] * width, size), np.repeat(x[mine], size)
        cell += self.number.take(post)
        product *= self.weight.take(post)
        dense = np.bincount(cell, product, n * width).reshape(n, width).astype(float, copy=False)
        # the frequent terms, in the blocks from the first to the last whose bound reaches the k-th best so far
        often = np.flatnonzero(row >= 0)
        if len(often):
            row, much, of = row[often], x[often], who[often]
            start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            some, best = of[start], dense.reshape(n, self.blocks, BLOCK).max(axis=2)
            # as many blocks have an example that good; copies that don't count may be these
            low = np.partition(best, -k, axis=1)[:, -k] if but is None and k <= self.blocks else np.zeros(n)
            bound = best[some] + np.add.reduceat(much[:, None] * self.most[row], start)
            able = bound >= low[some, None] - 1e-12
            a, b = able.argmax(axis=1) * BLOCK, width - able[:, ::-1].argmax(axis=1) * BLOCK
            each = np.diff(np.r_[start, len(of)])
            more = np.empty(width)
            for q, r, v, i, j in zip(of.tolist(), row.tolist(), much.tolist(), np.repeat(a, each).tolist(), np.repeat(b, each).tolist()):
                dense[q, i:j] += np.multiply(self.rows[r, i:j], v, out=more[: j - i])
        low, most = self._low(dense, k, but)
        low = np.maximum(low, 1e-300)
        # no cosine that isn't 0 is so small
        who, part = np.nonzero(most >= low[:, None])
        cos = dense.reshape(n, PARTED, -1)[who, :, part]
        at, turn = np.nonzero(cos >= low[who, None])
        who, number, cos = who[at], turn * (width // PARTED) + part[at], cos[at, turn]
        if but is not None:
            other = self.copy_in.ravel()[number] != but[who]
            who, number, cos = who[other], number[other], cos[other]
        by = np.argsort(number.astype(np.uint16) if width < 1 << 16 else number, kind="stable")
        by = by[np.argsort(-cos[by], kind="stable")]
        by = by[np.argsort(who[by].astype(np.uint16) if n < 1 << 16 else who[by], kind="stable")]  # numpy sorts short integers by radix
        who, number, cos = who[by], number[by], cos[by]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        return tuple(a[rank < k] for a in (who, number, cos))

    def _low(self, dense: np.ndarray, k: int, but: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(a number for each query that its k-th best isn't below, the largest cosine in each part): the k-th largest of the parts' largest."""
        if but is not None:
            dense = np.where(self.copy_in.ravel() == but[:, None], 0, dense)
        most = dense.reshape(len(dense), PARTED, -1).max(axis=1)
        return np.partition(most, -k, axis=1)[:, -k] if k <= most.shape[1] else np.zeros(len(dense)), most

    def shares(self, texts: Iterable[tuple[list[str], int]]) -> list[tuple[float, list[int]] | None]:
        """(share of toxic votes, evidence) of each text (words, the text whose copies don't count or -1); None without a known word."""
        out: list[tuple[float, list[int]] | None] = []
        parts, size, held = [], 0, []

        def search():
            of = np.repeat(np.arange(len(parts)), [p[0].max() + 1 if len(p[0]) else 0 for p in parts])
            start = np.searchsorted(of, np.arange(len(parts)))
            who = np.concatenate([p[0] + s for p, s in zip(parts, start)])
            n = len(of)
            top: list[list[tuple[float, list[int]]]] = [[] for _ in parts]
            term, x = (np.concatenate([p[c] for p in parts]) for c in (1, 2))
            but = np.repeat(np.array(held, np.int64), np.bincount(of, minlength=len(parts)))
            for a in range(0, n, BATCH):
                b = min(n, a + BATCH)
                lo, hi = np.searchsorted(who, [a, b])
                q, number, cos = self.nearest(who[lo:hi] - a, term[lo:hi], x[lo:hi], b - a, but=but[a:b] if (but >= 0).any() else None)
                whole = np.bincount(q, cos, b - a)
                share = (np.bincount(q, cos * self.toxic[number], b - a) + PRIOR * self.prior) / (whole + PRIOR)
                at = np.searchsorted(q, np.arange(b - a + 1))
                for k in np.unique(of[a:b]):
                    own = np.flatnonzero((of[a:b] == k) & (whole > 0))
                    own = own[np.argsort(-share[own], kind="stable")[:2]]
                    top[k] += [(float(share[j]), self.ids[number[at[j] : at[j + 1]][:5]].tolist()) for j in own]
            for t in top:
                t = sorted(t, key=lambda e: -e[0])[:2]
                out.append((sum(s for s, _ in t) / len(t), t[0][1]) if t else None)

        for words, but in texts:
            parts.append(self.passages(words))
            held.append(but)
            size += len(words)
            if size >= BATCH * PASSAGE:
                search()
                parts, size, held = [], 0, []
        if parts:
            search()
        return out

    def calibrated(self, p: float) -> float:
        a, b = self.curve
        z = a * math.log(p / (1 - p)) + b if 0 < p < 1 else math.inf * (p - 0.5)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

    def score(self, texts: list[str | None], known: dict[bytes, tuple[float, list[int]]]) -> list[tuple[float, list[int]]]:
        """(score, evidence) of each text; known: results of texts by digest, which copies get."""
        keys = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts]
        new = {k: t for k, t in zip(keys, texts) if k not in known}
        if len(known) + len(new) > CACHE:
            known.clear()
            new = dict(zip(keys, texts))
        for k, found in zip(new, self.shares((words_of(t), -1) for t in new.values())):
            known[k] = (self.prior if len(self.ids) else 0.0, []) if found is None else (self.calibrated(found[0]), found[1])
        return [known[k] for k in keys]


def fit_curve(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's logistic curve on log odds, a slope of at least 0, by damped Newton steps; the targets are smoothed."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    p = np.clip(p, 1e-6, 1 - 1e-6)
    x = np.log(p / (1 - p))
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        s = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        v = s * (1 - s) + 1e-9
        g = np.array([((s - t) * x).sum() + 1e-2 * (a - 1), (s - t).sum()])
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - float(np.clip(d[0], -1, 1)), b - float(np.clip(d[1], -1, 1))
        if np.abs(d).max() < 1e-9:
            break
    return max(a, 0.0), b


def _held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic and digest of the labelled rows that are learned from, at most LEARN_ROWS whatever repeats."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != 0)
    known = known.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEARN_ROWS)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")  # LEARN_ROWS ids
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    chosen = rows.select("doc_id", "digest").distinct().orderBy(F.xxhash64("doc_id", "digest"), "doc_id", "digest").limit(LEARN_ROWS)
    return rows.join(F.broadcast(chosen), ["doc_id", "digest"]).groupBy("doc_id", "digest").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame) -> Index:
    sample = written(examples(docs, labels), "examples").select("doc_id", "text", "toxic", "digest")

    def counted(batches):
        for batch in batches:
            own = [Counter(words_of(t)) for t in batch.column(1).to_pylist()]
            words = [sorted(c) for c in own]
            counts = [[c[w] for w in ws] for c, ws in zip(own, words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "toxic", "digest", "words", "counts"])

    got = sample.mapInArrow(lean(counted), "doc_id long, toxic int, digest binary, words array<string>, counts array<long>").collect()  # at most LEARN_ROWS vectors
    index = Index((r["doc_id"], r["toxic"], bytes(r["digest"]), r["words"], r["counts"]) for r in got)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def alone(batches):
        index = shared.value
        for batch in batches:
            texts = ((words_of(t), index.copies[d]) for t, d in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()))
            found = index.shares(texts)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] if f else None for f in found], pa.float64()), pa.array(batch.column(2).to_pylist(), pa.int32())], ["p", "y"])

    got = sorted((r["p"], r["y"]) for r in sample.mapInArrow(lean(alone), "p double, y int").where("p IS NOT NULL").collect())  # at most LEARN_ROWS rows
    index.curve = fit_curve(np.array([p for p, _ in got]), np.array([y for _, y in got], float))
    return index


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of the nearest examples) for docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        known: dict = {}
        for batch in batches:
            out = shared.value.score(batch.column(1).to_pylist(), known)
            p = np.array([x[0] for x in out], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_held_out(i) for i in batch.column(0).to_pylist()], pa.bool_()), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([x[1] for x in out], pa.list_(pa.int64()))],
                ["doc_id", "held_out", "score", "predicted", "evidence"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted to be toxic, with their own columns."""
    index = docs.sparkSession.sparkContext.broadcast(train(docs, table(spark, sf_dir, "labels")))
    names, at = docs.columns, docs.columns.index("text")

    def keep(batches):
        known: dict = {}
        for batch in batches:
            own = [s < 0.5 for s, _ in index.value.score(batch.column(at).to_pylist(), known)]
            yield batch.filter(pa.array(own, pa.bool_()))

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(lean(keep), docs.schema)
