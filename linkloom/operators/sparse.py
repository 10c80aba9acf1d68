"""Exact top-k by TF-IDF cosine over an inverted index in files of the shared folder: no row is made for a pair of texts or a posting.

Terms are counted by Spark as strings. Tasks know them by a 64-bit hash, whose seed is one under which no two terms of the tables
fall together, so hashes stand for terms exactly. Tasks over the documents write blocks (sorted terms, places, documents, weights);
tasks over the queries map block after block, add up the products of all postings of their terms, and keep k a query.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.session import shared_dir, ship
from linkloom.shared_files import mapped, save

#: Files of the vocabulary, by the upper bits of the hash.
PARTS_BITS = 6
#: Tokens weighed at a time, postings of a block, queries searched at a time, scores held at a time.
TOKENS, POSTINGS, QUERIES, CELLS = 1 << 19, 1 << 20, 4096, 1 << 17


def hashed(term: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), term)


class _Vocabulary:
    """Places (a rank by hash) and idf of terms, from mapped files. sizes: by part."""

    def __init__(self, folder: str, sizes: dict[int, int]):
        self.parts, start = {}, 0
        for b in sorted(sizes):
            self.parts[b] = start, {k: np.asarray(v) for k, v in mapped(folder, f"terms-{b}").items()}
            start += sizes[b]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (-1: none) and idf of sorted hashes."""
        place, idf = np.full(len(h), -1, np.int64), np.zeros(len(h))
        cut = np.searchsorted(h >> np.uint64(64 - PARTS_BITS), np.arange((1 << PARTS_BITS) + 1, dtype=np.uint64))
        for b, (start, part) in self.parts.items():
            own = h[cut[b] : cut[b + 1]]
            if len(own):
                at = np.minimum(np.searchsorted(part["h"], own), len(part["h"]) - 1)
                hit = part["h"][at] == own
                place[cut[b] : cut[b + 1]] = np.where(hit, start + at, -1)
                idf[cut[b] : cut[b + 1]] = part["idf"][at]
        return place, idf

    def weigh(self, tokens: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, term and weight of each distinct known term of each row, in this order: sublinear tf times idf, of unit length."""
        known, back = np.unique(tokens, return_inverse=True)
        place, idf = self.find(known)
        kept = place[back] >= 0
        key, tf = np.unique(row[kept] * len(known) + back[kept], return_counts=True)
        row, back = np.divmod(key, max(1, len(known)))
        w = (1 + np.log(tf)) * idf[back]
        return row, place[back], w / np.sqrt(np.bincount(row, w * w, minlength=rows))[row]


def _pieces(batch: pa.RecordBatch):
    """(first row, rows, tokens, row of each token) of a batch, about TOKENS at a time, rows whole."""
    lists = batch.column(batch.schema.get_field_index("terms"))
    at = np.r_[0, np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(at, at[a] + TOKENS, "right")) - 1)
        yield a, b - a, flat[at[a] : at[b]], np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
        a = b


def _save_block(folder: str, ids: list[pa.Array], docs: list[np.ndarray], terms: list[np.ndarray], weights: list[np.ndarray]) -> pa.RecordBatch:
    """A block's file, and a row with its name and number of documents. Names are new, so a task that is run twice does no harm."""
    doc, term, w = np.concatenate(docs), np.concatenate(terms), np.concatenate(weights)
    order = np.argsort(term, kind="stable")
    have, first = np.unique(term[order], return_index=True)
    own = pa.concat_arrays(ids)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", own.type)])) as out:
        out.write_batch(pa.record_batch([own], names=["id"]))
    name = uuid.uuid4().hex
    save(folder, name, {"term": have, "at": np.r_[first, len(order)].astype(np.int64), "doc": doc[order].astype(np.int32), "w": w[order], "ids": np.frombuffer(sink.getvalue(), np.uint8)})
    return pa.record_batch([pa.array([name]), pa.array([len(own)], pa.int64())], names=["name", "docs"])


def _indexer(folder: str, sizes: dict[int, int]):
    def run(batches):
        words, held = _Vocabulary(folder, sizes), ([], [], [], [])
        docs = postings = 0
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            for a, n, tokens, row in _pieces(batch):
                row, term, w = words.weigh(tokens, row, n)
                have, doc = np.unique(row, return_inverse=True)
                if not len(have):
                    continue
                for x, v in zip(held, (ids.take(pa.array(a + have)), docs + doc, term, w)):
                    x.append(v)
                docs, postings = docs + len(have), postings + len(term)
                if postings >= POSTINGS:
                    yield _save_block(folder, *held)
                    held, docs, postings = ([], [], [], []), 0, 0
        if docs:
            yield _save_block(folder, *held)

    return run


_order: dict[str, tuple[pa.Array, list[np.ndarray]]] = {}


def _ranked(folder: str, names: list[str]) -> tuple[pa.Array, list[np.ndarray]]:
    """All documents' ids in their order, and the place there of each of a block's documents. A worker keeps the last index's."""
    if folder not in _order:
        _order.clear()
        blocks = [pa.ipc.open_stream(pa.py_buffer(bytes(mapped(folder, n)["ids"]))).read_all().column(0).combine_chunks() for n in names]
        ids = pa.concat_arrays(blocks)
        order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        _order[folder] = ids.take(pa.array(order)), np.split(rank, np.cumsum([len(b) for b in blocks])[:-1])
    return _order[folder]


class _Best:
    """The k best (score, then least document) of each of some queries, as found so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries, self.least = k, queries, np.zeros(queries)
        self.found = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        self.waiting, self.begun = 0, False

    def add(self, scores: np.ndarray, rank: np.ndarray) -> None:
        """scores: queries by documents. What can't reach the k best so far is left out; equals stay in."""
        least = self.least
        if not self.begun and scores.shape[1] > 4 * self.k:
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k])
        at = np.flatnonzero(scores >= np.maximum(least - 2e-9, 1e-10)[:, None])
        if not len(at):
            return
        score = np.round(scores.ravel()[at], 9)
        query, doc = np.divmod(at, scores.shape[1])
        self.found.append((query, score, rank[doc]))
        self.waiting += len(at)
        if not self.begun or self.waiting > 2 * self.k * self.queries:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """query, score, document and rank from 1, by query and rank."""
        query, score, doc = (np.concatenate(x) for x in zip(*self.found))
        some = score > 0
        query, score, doc = query[some], score[some], doc[some]
        order = np.lexsort((doc, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        n = np.bincount(query, minlength=self.queries)
        place = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)
        kept = place < self.k
        query, score, doc, place = query[kept], score[kept], doc[kept], place[kept]
        last = place == self.k - 1
        self.least[query[last]] = score[last]
        self.found, self.waiting, self.begun = [(query, score, doc)], 0, True
        return query, score, doc, place + 1


def _search(folder: str, names: list[str], ranks: list[np.ndarray], row: np.ndarray, term: np.ndarray, w: np.ndarray, rows: int, k: int):
    """settle()'s arrays for queries given as sorted (row, term, weight)."""
    asked, back = np.unique(term, return_inverse=True)
    best: dict[int, _Best] = {}
    step = max(1, min(rows, CELLS // max(len(r) for r in ranks)))
    cuts = np.searchsorted(row, np.arange(0, rows + step, step))
    for name, rank in zip(names, ranks):
        block = mapped(folder, name)
        have, at = np.asarray(block["term"]), np.asarray(block["at"])
        posts = np.empty(len(block["doc"]), np.complex128)  # document and weight side by side: one gather fetches both
        posts.real, posts.imag = block["doc"], block["w"]
        place = np.minimum(np.searchsorted(have, asked), len(have) - 1)
        start, size = at[place], np.where(have[place] == asked, at[place + 1] - at[place], 0)
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            n = size[back[a:b]]
            some = np.flatnonzero(n)
            if not len(some):
                continue
            n, which = n[some], back[a:b][some]
            queries = min(step, rows - i * step)
            spot = np.repeat(start[which] - (np.cumsum(n) - n), n)
            spot += np.arange(len(spot))
            cell = np.repeat((row[a:b][some] - i * step) * len(rank), n)
            found = posts.take(spot, mode="clip")
            cell += found.real.astype(np.int64)
            product = np.repeat(w[a:b][some], n)
            product *= found.imag
            best.setdefault(i, _Best(queries, k)).add(np.bincount(cell, product, minlength=queries * len(rank)).reshape(queries, len(rank)), rank)
    for i in sorted(best):
        query, score, doc, place = best[i].settle()
        yield query + i * step, score, doc, place


def _searcher(folder: str, sizes: dict[int, int], names: list[str], k: int, schema: pa.Schema):
    def found(ids, held, rows):
        row, term, w = (np.concatenate(x) for x in zip(*held))
        every, ranks = _ranked(folder, names)
        own = pa.concat_arrays(ids)
        for query, score, doc, place in _search(folder, names, ranks, row, term, w, rows, k):
            yield pa.record_batch([x.cast(t) for x, t in zip((own.take(pa.array(query)), every.take(pa.array(doc)), pa.array(score), pa.array(place)), schema.types)], schema=schema)

    def run(batches):
        words, ids, held, rows, terms = _Vocabulary(folder, sizes), [], [], 0, 0
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("id"))
            for a, n, tokens, row in _pieces(batch):
                row, term, w = words.weigh(tokens, row, n)
                ids.append(own.slice(a, n))
                held.append((row + rows, term, w))
                rows, terms = rows + n, terms + len(term)
                if rows >= QUERIES or terms >= POSTINGS:
                    yield from found(ids, held, rows)
                    ids, held, rows, terms = [], [], 0, 0
        if rows:
            yield from found(ids, held, rows)

    return run


def _whole(df: DataFrame) -> DataFrame:
    """One row for each id and side: texts of an id that repeats are joined, as its terms count together."""
    twice = df.groupBy("id", "side").agg(F.count("*").alias("n")).where("n > 1")
    return df if twice.isEmpty() else df.groupBy("id", "side").agg(F.array_join(F.collect_list("text"), " ").alias("text"))


def topk(queries: DataFrame, docs: DataFrame, word: str, k: int, min_df: int, max_df: float, least_max_df: int) -> DataFrame:
    """query_id, cand_id, score and rank from queries and docs, both (id, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = ship(docs.sparkSession)
    folder, n = f"{shared_dir(spark)}/sparse-{uuid.uuid4().hex}", docs.count()
    both = _whole(queries.withColumn("side", F.lit(0)).unionByName(docs.withColumn("side", F.lit(1))))
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(word), 0)
    seed, counts = 0, f"{folder}/counts"
    both.select("side", F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.sum("side").alias("df")).write.parquet(counts)
    counts = spark.read.schema("term string, df long").parquet(counts)
    while not counts.groupBy(hashed(F.col("term"), seed).alias("h")).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        seed += 1

    def keep(key, pdf):
        import pandas as pd

        h, idf = pdf["h"].to_numpy(np.int64).view(np.uint64), pdf["idf"].to_numpy(np.float64)
        order = np.argsort(h)
        save(folder, f"terms-{key[0]}", {"h": h[order], "idf": idf[order]})
        return pd.DataFrame({"part": [key[0]], "n": [len(h)]})

    idf = F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1
    vocabulary = counts.where((F.col("df") >= min_df) & (F.col("df") <= max(max_df * n, least_max_df))).select(hashed(F.col("term"), seed).alias("h"), idf.alias("idf"))
    vocabulary = vocabulary.groupBy(F.shiftrightunsigned("h", 64 - PARTS_BITS).cast("int").alias("part"))
    sizes = {r["part"]: r["n"] for r in vocabulary.applyInPandas(keep, "part int, n long").collect()}
    terms = both.select("id", "side", F.transform(words, lambda t: hashed(t, seed)).alias("terms"))
    names = [r["name"] for r in terms.where("side = 1").select("id", "terms").mapInArrow(_indexer(folder, sizes), "name string, docs long").collect()]
    one = both.select("id").schema[0].dataType
    kind = f"query_id {one.simpleString()}, cand_id {one.simpleString()}, score double, rank long"
    asked = terms.where("side = 0").select("id", "terms")
    if not names:
        return spark.createDataFrame([], kind)
    schema = to_arrow_schema(spark.createDataFrame([], kind).schema)
    return asked.mapInArrow(_searcher(folder, sizes, sorted(names), k, schema), kind)
