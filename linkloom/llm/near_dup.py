"""Near-duplicate documents: MinHash bands for candidates, signatures and then full shingle sets to confirm, stars for components.

Documents with one and the same shingle set form a class; only its representative (least id) is signed and searched.
Each document's signature is BANDS * ROWS universal hash minima; documents that agree on a whole band share a bucket,
which two of similarity 0.8 fail to do in every band with probability (1 - 0.8**ROWS)**BANDS. A bucket isn't expanded into all
pairs: its members are compared with its least member; only where members are then still in different components
are the other pairs between components compared, inside tasks that hold a bucket or two blocks of one and return links alone.
Pairs whose signatures tell a similarity far below the bound are dropped, the others are confirmed on full sets, read anew from
the texts of the documents concerned.

Defined results: null, empty and blank texts have no shingles, link with nothing and are kept; rows that share an id are one
document, with the links of all of its texts; rows without an id take part by their text: component_id is the least id that they
reach, and null, and they are kept, if they reach none; repeated rows have repeated results; an empty table gives no rows; other
columns aren't read, and `stage` hands them on as they are. Texts are shingled whole.

Inside, a class is a node: a long, its representative's id where that names one class only, else a negative hash of the class.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import lean, root_buckets, shared_dir, table, written
from linkloom.llm.components import components
from linkloom.shared_files import mapped, save

BANDS, ROWS = 40, 5
#: Percent of the union that two sets must share.
LEAST = 80
#: Signature agreement below which a pair isn't compared: about five standard deviations under LEAST.
ESTIMATE = 0.66
SEED = 7
#: Members of a bucket that are compared in one task.
BLOCK = 1024
MASK = (1 << 64) - 1
CACHE = 400_000

_rng = np.random.default_rng(SEED)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Hashes()


def shingle_set(text: str | None, width: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of width words; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[k : len(h) - n + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of the hashes (a * x + b) >> 32."""
    out = np.full(len(_A), 0xFFFFFFFF, np.uint64)
    for k in range(0, len(shingles), 2048):
        x = shingles[None, k : k + 2048] * _A[:, None]
        x += _B[:, None]
        np.minimum(out, x.min(axis=1) >> np.uint64(32), out=out)
    return out.astype(np.uint32)


def shard_of(doc: int, shards: int) -> int:
    return (doc * 0x9E3779B97F4A7C15 & MASK) * shards >> 64


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ column) * _MIX
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """docs (doc_id, key, text) with sizes, 128-bit prints of their sets, and signatures."""

    def run(batches):
        import xxhash

        for batch in batches:
            sizes, prints, sigs = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, width)
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "key", "n_shingles", "print", "sig"])

    return docs.mapInArrow(lean(run), "doc_id long, key long, n_shingles long, print binary, sig binary")


def _bands(signed: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            sizes = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), BANDS)
            keys = [band_keys(np.frombuffer(s, np.uint32)) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))], ["doc", "n", "band"])

    return signed.select("node", "n_shingles", "sig").mapInArrow(lean(run), "doc long, n long, band long")


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) that are links."""

    def alike(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
            keep = pa.array((a == b).mean(axis=1) >= ESTIMATE) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    def exact(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= LEAST * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sig = reps.select(F.col("node").alias("doc"), "sig")
    near = pairs.join(sig.withColumnsRenamed({"doc": "a", "sig": "sa"}), "a").join(sig.withColumnsRenamed({"doc": "b", "sig": "sb"}), "b")
    near = written(near.select("a", "b", "sa", "sb").mapInArrow(lean(alike), "a long, b long"), "near")
    wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    full = written(_sets(reps.join(wanted, "node", "left_semi"), docs, width).dropDuplicates(["doc"]), "sets")
    both = near.join(full.withColumnsRenamed({"doc": "a", "set": "sa"}), "a").join(full.withColumnsRenamed({"doc": "b", "set": "sb"}), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(lean(exact), "a long, b long")


def _sets(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """doc (the node) and its whole set, read anew from the texts of docs; a node once for each row of its text."""

    def run(batches):
        import xxhash

        for batch in batches:
            out = [shingle_set(t, width).tobytes() for t in batch.column(2).to_pylist()]
            keep = pa.array([xxhash.xxh3_128_digest(s) == p for s, p in zip(out, batch.column(1).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc", "set"]).filter(keep)

    return docs.select("key", "text").join(wanted.select("node", "key", "print"), "key").select("node", "print", "text").mapInArrow(lean(run), "doc long, set binary")


def _apart_links(rest: DataFrame, reps: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Links (a, b) between members (band, m, doc, n, component) of one bucket and different components.

    Pairs are compared within tasks and only links leave them: a bucket up to BLOCK members is in one task with others, a
    larger one is cut into blocks of which each two meet in a task of their own. A pair that shares several bands is compared in
    the first of them. Signatures cut to bytes come first; what they leave is settled on full sets, which lie in
    memory-mapped files of the shared folder.
    """
    spark = rest.sparkSession
    wanted = rest.select(F.col("doc").alias("node")).distinct()
    shards = max(4, root_buckets(wanted.count()) // 4)
    folder = f"{shared_dir(spark)}/sets-{uuid.uuid4().hex}"

    def dealt_to(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shard_of(i, shards) for i in batch.column(0).to_pylist()], pa.int32()), batch.column(0), batch.column(1)], ["shard", "doc", "set"])

    def store(key, pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates("doc").sort_values("doc")
        sizes = pdf["set"].str.len().to_numpy(np.int64) // 8
        save(folder, str(key[0]), {"doc": pdf["doc"].to_numpy(np.int64), "at": np.r_[0, np.cumsum(sizes)].astype(np.int64), "set": np.frombuffer(b"".join(pdf["set"]), np.uint64)})
        return pd.DataFrame({"n": [len(pdf)]})

    marked = written(reps.select("node", "key", "print", "sig").join(wanted, "node", "left_semi"), "marked")
    _sets(marked, docs, width).mapInArrow(lean(dealt_to), "shard int, doc long, set binary").groupBy("shard").applyInPandas(store, "n long").agg(F.sum("n")).collect()

    def codes(batches):
        for batch in batches:
            out = []
            for sig in batch.column(1).to_pylist():
                sig = np.frombuffer(sig, np.uint32)
                out.append(sig.astype(np.uint8).tobytes() + (band_keys(sig).view(np.uint64) >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc", "code"])

    coded = rest.join(marked.select("node", "sig").mapInArrow(lean(codes), "doc long, code binary"), "doc")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc"), blocks).cast("int")
    dealt = coded.withColumn("own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    lo, hi = F.least("own", "_with"), F.greatest("own", "_with")
    task = F.when(blocks == 1, F.pmod(F.xxhash64("band"), F.lit(8 * shards))).otherwise(F.xxhash64("band", lo, hi))
    dealt = dealt.select(task.alias("task"), "band", lo.alias("lo"), hi.alias("hi"), "own", "doc", "n", "component", "code")

    def compare(pdf):
        import pandas as pd

        files: dict[int, dict] = {}

        def full(doc):
            k = shard_of(doc, shards)
            if k not in files:
                files[k] = mapped(folder, str(k))
            f = files[k]
            at = int(np.searchsorted(f["doc"], doc))
            return f["set"][f["at"][at] : f["at"][at + 1]]

        out = []
        for (band, lo, hi), own in pdf.groupby(["band", "lo", "hi"], sort=False):
            code = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), -1)
            sig, keys = code[:, : len(_A)], np.ascontiguousarray(code[:, len(_A) :]).view("<u4")
            here = int(np.flatnonzero((keys == np.uint32((int(band) & MASK) >> 32)).all(axis=0))[0])
            doc, n, component, block = (own[c].to_numpy() for c in ("doc", "n", "component", "own"))
            known: dict[int, np.ndarray] = {}
            for i in range(len(own)):
                # within a block each pair once; of two blocks only pairs between them
                others = np.arange(i + 1, len(own))
                if lo != hi:
                    others = others[block[others] != block[i]]
                others = others[(component[others] != component[i]) & (100 * np.minimum(n[others], n[i]) >= LEAST * np.maximum(n[others], n[i]))]
                others = others[~(keys[others, :here] == keys[i, :here]).any(axis=1)]
                others = others[(sig[others] == sig[i]).mean(axis=1) >= ESTIMATE]
                if not len(others):
                    continue
                for k in (i, *others.tolist()):
                    if k not in known:
                        known[k] = full(int(doc[k]))
                mine, sizes = known[i], np.array([len(known[k]) for k in others])
                every = np.concatenate([known[k] for k in others])
                at = np.searchsorted(mine, every)
                at[at == len(mine)] = 0
                both = np.add.reduceat((mine[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
                for k in others[100 * both >= LEAST * (len(mine) + sizes - both)]:
                    out.append((min(doc[i], doc[k]), max(doc[i], doc[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("task").applyInPandas(compare, "a long, b long").distinct()


def classes(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for docs (doc_id, text), a row for each row."""
    # rows without an id are found again by their text
    docs = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"), "text")
    signed = written(_signed(docs, width), "signatures")
    of_print = signed.where("print IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull(), "key")).alias("_k"))
    of_print = of_print.select("print", "rep", F.col("_k.key").alias("key"))
    first = of_print.where("rep IS NOT NULL").groupBy("rep").agg(F.min("print").alias("_first"))
    hashed = -F.shiftrightunsigned(F.xxhash64("print"), 2) - F.lit(1 << 62)
    nodes = of_print.join(first, "rep", "left").withColumn("node", F.when(F.col("_first") == F.col("print"), F.col("rep")).otherwise(hashed))
    nodes = written(nodes.select("print", "rep", "key", "node"), "nodes")
    member = written(signed.select("doc_id", "n_shingles", "print").join(nodes.select("print", "node"), "print").select("doc_id", "n_shingles", "node"), "members")
    reps = signed.select("key", "n_shingles", "print", "sig").join(nodes.select("print", F.col("key").alias("_key"), "node"), "print").where("key = _key").dropDuplicates(["node"])
    reps = written(reps.select("node", "key", "n_shingles", "print", "sig"), "representatives")
    rows = _bands(reps)
    # buckets of two or more; the least member stands for its bucket
    least = rows.groupBy("band").agg(F.min("doc").alias("a"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    buckets = written(rows.join(least, "band"), "buckets")
    fits = lambda x, y: (100 * F.least(x, y) >= LEAST * F.greatest(x, y))
    sizes = reps.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"))
    pairs = buckets.where("doc <> a").select("a", F.col("doc").alias("b"), "n").distinct().join(sizes, "a").where(fits(F.col("n"), F.col("n_a"))).select("a", "b")
    links = written(_confirmed(pairs, reps, docs, width), "links")
    found = components(links)
    # members of a bucket that are still apart
    placed = buckets.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    apart = placed.groupBy("band").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("m")).where("c1 <> c2").select("band", "m")
    rest = written(placed.join(apart, "band").select("band", "m", "doc", "n", "component"), "apart")
    links = links.unionByName(written(_apart_links(rest, reps, docs, width), "more"))
    # the texts of one id
    of_id = member.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    of_id = member.join(of_id.select("doc_id", "a"), "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    found = nodes.select("node", "rep").join(components(links.unionByName(of_id)), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = found.select("node", "component").join(named, "component").select("node", "component_id")
    out = member.join(named, "node").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(signed.where("print IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), 2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, on shingles of five words. Rows without an id stay: nothing names the one to drop."""
    dropped = classes(docs, 5).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_near_dup_id")).distinct()
    kept = docs.join(dropped, F.col("doc_id") == F.col("_near_dup_id"), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
