"""Near-duplicate vectors by sorted projection passes.

In each pass, vectors get a 64-bit key, the signs of 64 seeded random projections, and stand in the order of the
keys; each is compared with its next WINDOW neighbours by cosine in double precision, and pairs that reach the bound are kept
over all passes. Two vectors at the bound agree in a sign with a known probability. Each pass measures for each vector how
many leading signs a partner must share to stand within its window; over the passes that gives the chance that a pair at
the bound is missed. Vectors for which it is above MISS, as in dense regions, where many more than WINDOW share
long runs of signs, are compared whole with each other: they are dealt to leaders, cut into blocks of about BLOCK, and pairs of blocks
are left out only where the triangle inequality of angles rules out a link. So a pair is missed with a chance of at
most MISS, and nearer pairs more rarely, whatever the distribution. Equal vectors are one class and searched once. A window
that is full of links may hide more: components of the links found are compared all against all, in blocks of BLOCK.

A pass's order is cut at quantiles of its keys into blocks of equal size, each with the first WINDOW of the next.

Defined results: null and zero vectors and vectors with null or non-finite components link with nothing and are
kept; vectors of different length are not compared; an empty table gives no rows; rows that repeat an id are rows of their own that link if their vectors do.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import root_buckets, shared_dir, table, written
from linkloom.llm.components import components
from linkloom.shared_files import mapped, save

LEAST = 0.9
WINDOW = 64
#: Share of pairs at the bound itself that all passes together may miss.
MISS = 0.01
BLOCK = 1024
#: Vectors of a pass in a task, about.
RUN = 4096
#: Leading signs, beyond log2(n / WINDOW), that a partner must share in a pass where no region is dense, about.
MORE_SIGNS = 1.5
#: Leaders that vectors compared whole are dealt to, at most.
LEADERS = 512
SEED = 5


def passes(n: int, least: float = LEAST, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes that suffice where no region is dense; what they leave open is measured in them."""
    signs = math.log2(max(n, 1) / window)
    together = (1 - math.acos(least) / math.pi) ** (signs + MORE_SIGNS if signs > 0 else 0.0)
    return 1 if together >= 1 - miss else math.ceil(math.log(miss) / math.log(1 - together))


def _planes(k: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, k, dim]).standard_normal((dim, 64))


def _units(vectors: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _classes(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vec (doubles as bytes; null if the vector links with nothing)."""

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                a = None if not v or any(x is None for x in v) else np.array(v, np.float64)
                # scaled, so that very large or small components don't overflow
                ok = a is not None and np.isfinite(a).all() and a.any()
                out.append((a + 0.0).tobytes() if ok and np.isfinite(np.linalg.norm(a)) and np.linalg.norm(a) > 1e-150 else (a / np.abs(a).max() + 0.0).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "vec"])

    return df.select(F.col(key).cast("long"), vector).mapInArrow(run, "id long, vec binary")


def _signs_needed(key: np.ndarray, first: bool, last: bool) -> np.ndarray:
    """For each of a run's sorted keys, leading signs that a row must share with it to be surely within WINDOW places.

    Unless the run is the first or the last, rows beyond its ends are taken to share as many signs as the end does.
    """
    bits = key.view(np.uint64) ^ np.uint64(1 << 63)

    def shared(at, open_end):
        x = bits ^ bits[np.clip(at, 0, len(bits) - 1)]
        # the bit length in two halves, each exact as a double
        high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
        length = np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])
        return np.where(open_end & ((at < 0) | (at >= len(bits))), -1, 64 - length)

    n = np.arange(len(bits))
    return 1 + np.maximum(shared(n - WINDOW - 1, first), shared(n + WINDOW + 1, last))


def _window_pairs(rows: DataFrame, n: int, least: float) -> DataFrame:
    """Pairs (a, b) of rows (id, vec) that the passes find; and rows with null b: miss is the log of the chance that a pair of a at the bound is missed."""
    count = passes(n, least)
    agree = 1 - math.acos(least) / math.pi

    def keys(batches):
        for batch in batches:
            ids, vecs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for dim in {len(v) for v in vecs}:
                own = [k for k, v in enumerate(vecs) if len(v) == dim]
                u = _units([vecs[k] for k in own])
                for p in range(count):
                    bits = np.packbits(u @ _planes(p, dim // 8) > 0, axis=1).view(">u8").ravel().astype(np.uint64)
                    order = (bits ^ np.uint64(1 << 63)).view(np.int64)  # signed, in the same order
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(own), pa.int32()), pa.array(order), pa.array(ids[own]), pa.array([vecs[k] for k in own], pa.binary())], ["pass", "key", "id", "vec"])

    schema = "pass int, key long, id long, vec binary"
    cells = max(1, n // RUN)
    keyed = rows.mapInArrow(keys, schema)
    if cells > 1:
        at = [k / cells for k in range(1, cells)]
        # quantiles of each pass's keys: passes * n / RUN numbers
        cuts = keyed.groupBy("pass").agg(F.percentile_approx("key", at, 10 * cells).alias("cuts"))
        keyed = keyed.join(F.broadcast(cuts), "pass")
        keyed = keyed.withColumn("cell", F.aggregate("cuts", F.lit(0), lambda s, c: s + F.when(F.col("key") > c, 1).otherwise(0))).drop("cuts")
    else:
        keyed = keyed.withColumn("cell", F.lit(0))
    # the first WINDOW of a cell also stand at the end of the one before
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("pass", "cell").orderBy("key", "id"))
    both = keyed.withColumn("_n", rank)
    both = both.withColumn("_of", F.col("cell"))
    both = both.withColumn("cell", F.explode(F.when((F.col("_n") <= WINDOW) & (F.col("cell") > 0), F.array(F.col("cell"), F.col("cell") - 1)).otherwise(F.array("cell"))))

    def near(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["key", "id"], kind="stable")
        cell = int(pdf["cell"].iloc[0])
        out, open_ids, miss = [], [], []
        for _, own in pdf.groupby(pdf["vec"].str.len(), sort=False):
            u, ids = _units(own["vec"].tolist()), own["id"].to_numpy()
            mine = (own["_of"] == cell).to_numpy()
            need = _signs_needed(own["key"].to_numpy(), cell == 0, cell == cells - 1)
            open_ids.append(ids[mine])
            # a partner that shares so many signs is met; none can share more than all 64
            miss.append(np.log(np.maximum(1 - np.where(need <= 64, agree ** need.astype(float), 0.0), 1e-300))[mine])
            for d in range(1, min(WINDOW, len(own) - 1) + 1):
                hit = np.flatnonzero(np.einsum("ij,ij->i", u[:-d], u[d:]) >= least)
                if len(hit):
                    out.append(np.stack([ids[hit], ids[hit + d]], 1))
        found = np.unique(np.sort(np.concatenate(out), axis=1), axis=0) if out else np.empty((0, 2), np.int64)
        met = pd.DataFrame({"a": found[:, 0], "b": pd.array(found[:, 1], "Int64"), "miss": 0.0})
        rest = np.concatenate(open_ids)
        return pd.concat([met, pd.DataFrame({"a": rest, "b": pd.array([None] * len(rest), "Int64"), "miss": np.concatenate(miss)})])

    found = both.select("pass", "cell", "_of", "key", "id", "vec").groupBy("pass", "cell").applyInPandas(near, "a long, b long, miss double")
    return found.groupBy("a", "b").agg(F.sum("miss").alias("miss"))


def _leaders(u: np.ndarray, k: int) -> np.ndarray:
    """k of the unit vectors, each the farthest from those before it."""
    chosen, most = [0], u @ u[0]
    while len(chosen) < min(k, len(u)):
        chosen.append(int(most.argmin()))
        most = np.maximum(most, u @ u[chosen[-1]])
    return u[chosen]


def _joined(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a matrix of links the least row of their component; for a column without links the number of rows."""
    none = len(hit)
    left = np.arange(none)
    while True:
        right = np.where(hit, left[:, None], none).min(0)
        new = np.minimum(left, np.where(hit, right[None, :], none).min(1))
        new = new[new]
        if (new == left).all():
            return left, right
        left = new


def _whole_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that join the components of all links among rows (id, vec): for each two blocks a spanning forest, not each link."""
    spark = rows.sparkSession
    rows = rows.withColumn("dim", (F.length("vec") / 8).cast("int"))
    folder = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    leaders = {}
    for r in rows.groupBy("dim").count().collect():
        k = min(LEADERS, -(-r["count"] // BLOCK))
        # ids are hashes: their order is a random one
        some = rows.where(F.col("dim") == r["dim"]).orderBy("id").limit(8 * k).select("vec").collect()
        leaders[r["dim"]] = _leaders(_units([bytes(x["vec"]) for x in some]), k)

    def deal(batches):
        for batch in batches:
            vecs = batch.column(1).to_pylist()
            group = [int((_units([v]) @ leaders[len(v) // 8].T).argmax()) for v in vecs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group, pa.int32())], ["id", "vec", "dim", "group"])

    dealt = written(rows.select("id", "vec", "dim").mapInArrow(deal, "id long, vec binary, dim int, group int"), "dealt")
    sizes = dealt.groupBy("dim", "group").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = dealt.join(sizes, ["dim", "group"]).withColumn("part", F.pmod(F.xxhash64("id", "dim"), F.col("parts")))

    def store(pdf):
        import pandas as pd

        dim, group, part = (int(pdf[c].iloc[0]) for c in ("dim", "group", "part"))
        u = _units(pdf["vec"].tolist())
        mean = u.mean(0)
        mean = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-9 else u[0]
        name = f"{dim}-{group}-{part}"
        save(folder, name, {"ids": pdf["id"].to_numpy(), "u": u.ravel()})
        return pd.DataFrame({"dim": [dim], "name": [name], "mean": [mean.tobytes()], "radius": [float(np.arccos(np.clip((u @ mean).min(), -1, 1)))]})

    # one row a block
    blocks = sorted(dealt.groupBy("dim", "group", "part").applyInPandas(store, "dim int, name string, mean binary, radius double").collect(), key=lambda r: (r["dim"], r["name"]))
    schema = "a long, b long"
    if not blocks:
        return spark.createDataFrame([], schema)
    dims: dict[int, list[int]] = {}
    for n, r in enumerate(blocks):
        dims.setdefault(r["dim"], []).append(n)
    heads = spark.sparkContext.broadcast(([r["name"] for r in blocks], [r["dim"] for r in blocks], np.array([r["radius"] for r in blocks]), {d: np.stack([np.frombuffer(blocks[n]["mean"]) for n in at]) for d, at in dims.items()}, {d: at[0] for d, at in dims.items()}))
    theta = math.acos(least) + 1e-6

    def compare(batches):
        names, dim_of, radius, means, start = heads.value

        def block(n):
            a = mapped(folder, names[n])
            return np.array(a["ids"]), np.array(a["u"]).reshape(-1, dim_of[n])

        for batch in batches:
            for n in batch.column(0).to_pylist():
                own, first = means[dim_of[n]], start[dim_of[n]]
                count, at = len(own), n - first
                # each block meets the half of the ring of blocks that follows it
                for step in range(count // 2 + 1):
                    if 2 * step == count and at >= step:
                        continue
                    other = (at + step) % count
                    apart = math.acos(max(-1.0, min(1.0, float(own[at] @ own[other]))))
                    if step and apart - radius[n] - radius[first + other] > theta:
                        continue
                    ids, u = block(n)
                    ids2, u2 = (ids, u) if not step else block(first + other)
                    hit = u @ u2.T >= least
                    left, right = _joined(hit)
                    x, y = np.flatnonzero(left != np.arange(len(ids))), np.flatnonzero(right < len(ids)) if step else np.empty(0, int)
                    yield pa.RecordBatch.from_arrays([pa.array(np.r_[ids[x], ids2[y]]), pa.array(np.r_[ids[left[x]], ids[right[y]]])], ["a", "b"])

    return spark.range(0, len(blocks), 1, min(len(blocks), 1024)).mapInArrow(compare, schema)


def _all_links(rows: DataFrame, buckets: int, least: float) -> DataFrame:
    """id and the weight of other rows linked with it, for rows (id, vec, weight, component): all pairs within components, by blocks."""
    sizes = rows.groupBy("component").agg(F.count("*").alias("_size"))
    rows = rows.join(sizes, "component").withColumn("_blocks", F.ceil(F.col("_size") / BLOCK).cast("int"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    lo, hi = F.least("_own", "_with"), F.greatest("_own", "_with")
    # small components share a task, each pair of blocks of a large one has its own
    task = F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(buckets))).otherwise(F.xxhash64("component", lo, hi))
    rows = rows.select("component", lo.alias("lo"), hi.alias("hi"), F.col("_own").alias("own"), "id", "vec", "weight", task.alias("task"))

    def links(pdf):
        import pandas as pd

        out = []
        for (_, lo, hi), own in pdf.groupby(["component", "lo", "hi"], sort=False):
            u, ids, w = _units(own["vec"].tolist()), own["id"].to_numpy(), own["weight"].to_numpy()
            block = own["own"].to_numpy()
            left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            hit = u[left] @ u[right].T >= least
            if lo == hi:
                np.fill_diagonal(hit, False)
            else:
                out.append((ids[right], w[left] @ hit))
            out.append((ids[left], hit @ w[right]))
        return pd.DataFrame({"id": np.concatenate([x for x, _ in out]), "n": np.concatenate([x for _, x in out]).astype(np.int64)})

    return rows.groupBy("task").applyInPandas(links, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def link(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id and kept."""
    rows = written(_classes(df, key, vector), "vectors")
    # equal vectors are one class, named by its least id; ids are numbered anew only within it
    groups = written(rows.where("vec IS NOT NULL").groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "classes")
    n = groups.count()
    # two classes of one least id (an id that repeats) are told apart by their vectors
    nodes = groups.select(F.xxhash64("vec").alias("node"), "id", "vec", "weight")
    nodes = written(nodes, "nodes")
    searched = nodes.select(F.col("node").alias("id"), "vec")
    windows = written(_window_pairs(searched, n, least), "windows")
    dense = windows.where(F.col("b").isNull() & (F.col("miss") > math.log(MISS))).select(F.col("a").alias("id"))
    pairs = windows.where("b IS NOT NULL").select("a", "b").unionByName(_whole_pairs(written(searched.join(dense, "id"), "dense"), least))
    found = components(pairs).join(nodes.select("node", "id"), "node")
    first = found.groupBy("component").agg(F.min("id").alias("least"))
    found = written(found.join(first, "component").select("node", "component", "least"), "found")
    inside = nodes.join(found, "node").select(F.col("node").alias("id"), "vec", "weight", "component")
    counts = _all_links(inside, root_buckets(n), least).withColumnRenamed("id", "node")
    of_class = nodes.join(found.select("node", "least"), "node", "left").join(counts, "node", "left")
    of_class = of_class.select("vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    out = rows.join(of_class, "vec", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op5_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
