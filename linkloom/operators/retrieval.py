"""Candidate retrieval: TF-IDF top-k, exact dense neighbours, capped postings, reverse lookup."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators import sparse
from linkloom.session import written

#: Defaults of retrieval.
TOP_K, MIN_DF, MAX_DF, POSTING_DF = 50, 2, 0.01, 200
WORD = r"[\p{L}\p{N}]{2,}"


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank from 1. Spark prunes beyond k before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)
    return ranked.withColumn(rank, F.col(rank).cast("long"))


def term_counts(df: DataFrame, key: str, text: Column, *more: str) -> DataFrame:
    """key, the columns of more (that the key decides), term and tf."""
    split = df.select(F.col(key).alias("_k"), *more, F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)).alias("term"))
    return split.groupBy("_k", *more, "term").agg(F.count("*").alias("tf")).withColumnRenamed("_k", key)


def tfidf_index(docs: DataFrame, key: str, text: Column, min_df: int = MIN_DF, max_df: float = MAX_DF, least_max_df: int = 10) -> tuple[DataFrame, DataFrame]:
    """(weights: key, term, w; vocabulary: term, df, idf) of the searched side.

    Terms stay from min_df up to the greater of max_df * rows and least_max_df rows: a share alone would empty the vocabulary of
    a small table, and the bound on document frequency is what bounds the postings of `tfidf_topk`.
    """
    tf = written(term_counts(docs, key, text), "terms")
    vocabulary = _vocabulary(tf, docs.count(), min_df, max_df, least_max_df)
    return weigh(tf, key, vocabulary), vocabulary


def _vocabulary(tf: DataFrame, n: int, min_df: int, max_df: float, least_max_df: int) -> DataFrame:
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max(max_df * n, least_max_df)))
    return df.select("term", "df", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def weigh(tf: DataFrame, key: str, vocabulary: DataFrame, *more: str) -> DataFrame:
    """Sublinear tf times idf, of unit length over the vocabulary's terms. A key's terms are bounded by its text."""
    raw = tf.join(vocabulary.select("term", "idf"), "term").select(key, *more, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key, *more))))


def tfidf_topk(queries: DataFrame, query_key: str, query_text: Column, docs: DataFrame, doc_key: str, doc_text: Column, k: int = TOP_K, min_df: int = MIN_DF, max_df: float = MAX_DF, least_max_df: int = 10) -> DataFrame:
    """query_id, cand_id, score and rank: the k documents of highest cosine above 0 for each query; of equals the least id.

    Weights are those of `tfidf_index`. Pairs are never rows: tasks add up their scores over an inverted index.
    """
    side = lambda df, key, text: df.select(F.col(key).alias("id"), text.alias("text"))
    return sparse.topk(side(queries, query_key, query_text), side(docs, doc_key, doc_text), WORD, k, min_df, max_df, least_max_df)


def dense_topk(queries: DataFrame, docs: DataFrame, key: str, vector: str, k: int = TOP_K, block: int = 4096, same: bool = False) -> DataFrame:
    """Exact nearest neighbours by cosine: query_id, cand_id, score, rank.

    Documents are dealt into blocks; each block meets each run of queries in a task of its own as one matrix product that keeps k a query, and the
    lists are merged: no pair row is made, and no side is broadcast.
    """
    n_q, n_d = queries.count(), docs.count()
    qs, ds = max(1, -(-n_q // block)), max(1, -(-n_d // block))
    deal = lambda df, n, side: df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vec"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(side))
    q = deal(queries, qs, "qb").withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(ds - 1))))
    d = deal(docs, ds, "db").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qs - 1))))

    def near(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "cand_id": [], "score": []})
        unit = lambda s: (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))(np.stack(s.to_list()))
        ids = right["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, cos = ids[order], np.round(unit(left["vec"]) @ unit(right["vec"])[order].T, 9)
        out = []
        for n, row in zip(left["id"].to_numpy(), cos):
            if not same:
                row = np.where(ids == n, -np.inf, row)
            best = np.lexsort((ids, -row))[:k]
            best = best[np.isfinite(row[best])]
            out.append(pd.DataFrame({"query_id": n, "cand_id": ids[best], "score": row[best]}))
        return pd.concat(out)

    kind = dict(docs.dtypes)[key]
    found = q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInPandas(near, f"query_id {kind}, cand_id {kind}, score double")
    return top(found, ["query_id"], [F.desc("score"), F.asc("cand_id")], k)


def block_jaccard(rows: DataFrame, key: str, text: str, by: list[str], n: int = 3, tile: int = 1024) -> DataFrame:
    """left, right and jaccard (of character n-grams as `similarity.char_ngrams` has them, six digits) of all pairs of keys left < right that agree in by.

    Blocks are dealt into tiles, and each two tiles of a block meet in a task as one product of their distinct texts' n-grams: equal texts
    are compared once, whatever a block's size. A null text has a null measure; rows without a key or a block have no pair.
    """
    rows = rows.select(*by, F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_key").isNotNull())
    tiles = rows.groupBy(*by).agg(F.ceil(F.count("*") / tile).cast("int").alias("_tiles"))
    dealt = rows.join(tiles, by).withColumn("_tile", F.pmod(F.xxhash64("_key"), F.col("_tiles")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).drop("_tiles")
    dealt = dealt.withColumns({"_low": F.least("_tile", "_other"), "_high": F.greatest("_tile", "_other")}).drop("_other")

    def grams(s):
        s = s.replace(" ", "")
        return ({s[i : i + n] for i in range(len(s) - n + 1)} if len(s) >= n else {s}) if s else set()

    def met(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.combine_chunks()
        keys, tile, low = table["_key"].combine_chunks(), table["_tile"].to_numpy(), table["_low"][0].as_py()
        order = pc.array_sort_indices(keys).to_numpy()
        place = np.empty(len(order), np.int64)  # equal keys share one
        by_key = keys.take(pa.array(order))
        place[order] = np.r_[0, np.cumsum(pc.not_equal(by_key[1:], by_key[:-1]).to_numpy(zero_copy_only=False))]
        coded = table["_text"].combine_chunks().dictionary_encode()
        code = coded.indices.fill_null(-1).to_numpy()
        sets = [grams(s) for s in coded.dictionary.to_pylist()]
        size = np.array([len(x) for x in sets], np.int64)
        known: dict[str, int] = {}
        at = np.repeat(np.arange(len(sets)), size)
        gram = np.array([known.setdefault(g, len(known)) for x in sets for g in x], np.int64)
        both = np.zeros((len(sets), len(sets)), np.float32)
        for start in range(0, len(known), 4096):  # counts stay below 2 ** 24, which floats hold exactly
            some = (gram >= start) & (gram < start + 4096)
            has = np.zeros((len(sets), min(4096, len(known) - start)), np.float32)
            has[at[some], gram[some] - start] = 1
            both += has @ has.T
        both = both.astype(np.int64)
        union = size[:, None] + size - both
        # half up, as Spark and SQL round; of two empty sets 1
        share = np.where(union == 0, 1.0, (2_000_000 * both + union) // np.maximum(2 * union, 1) / 1e6)
        share = np.pad(share, ((0, 1), (0, 1)), constant_values=np.nan)  # code -1
        if low == table["_high"][0].as_py():
            i, j = np.triu_indices(len(order), 1)
            i, j = order[i], order[j]
        else:
            a, b = np.flatnonzero(tile == low), np.flatnonzero(tile != low)
            i, j = np.repeat(a, len(b)), np.tile(b, len(a))
            swap = place[i] > place[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
        apart = place[i] < place[j]
        if not apart.all():
            i, j = i[apart], j[apart]
        value = share[code[i], code[j]]
        return pa.table({"left": keys.take(pa.array(i)), "right": keys.take(pa.array(j)), "jaccard": pa.array(value, mask=np.isnan(value))})

    kind = dict(dealt.dtypes)["_key"]
    return dealt.groupBy(*by, "_low", "_high").applyInArrow(met, f"left {kind}, right {kind}, jaccard double")


def postings_topk(queries: DataFrame, query_key: str, keys: Column, docs: DataFrame, doc_key: str, doc_keys: Column, k: int, max_df: int = POSTING_DF) -> DataFrame:
    """Documents that share a key with the query: the first k by (position of the key in the query's list, document).

    keys and doc_keys are arrays. Keys of more than max_df documents are dropped: that is the operator's meaning, and bounds the join.
    """
    posts = docs.select(F.col(doc_key).alias("cand_id"), F.explode(F.array_distinct(doc_keys)).alias("_key")).where("_key <> ''")
    rare = posts.groupBy("_key").agg(F.count("*").alias("_df")).where(F.col("_df") <= max_df).select("_key")
    q = queries.select(F.col(query_key).alias("query_id"), F.posexplode(keys).alias("_pos", "_key")).where("_key <> ''")
    # the rare keys that are asked for, before documents are joined
    hits = q.join(rare, "_key").join(posts, "_key").groupBy("query_id", "cand_id").agg(F.min("_pos").alias("key_pos"))
    return top(hits, ["query_id"], [F.asc("key_pos"), F.asc("cand_id")], k)


def reverse_topk(found: DataFrame, k: int = 3) -> DataFrame:
    """For each candidate its k best queries: rank, gap to the next of its list (0 for the last) and their number."""
    best = top(found.select("cand_id", "query_id", "score"), ["cand_id"], [F.desc("score"), F.asc("query_id")], k, "reverse_rank")
    w = Window.partitionBy("cand_id")
    gap = F.col("score") - F.lead("score").over(w.orderBy("reverse_rank"))
    return best.select("cand_id", "query_id", "reverse_rank", F.round(F.coalesce(gap, F.lit(0.0)), 6).alias("reverse_gap"), F.count("*").over(w).alias("reverse_claimants"))
