"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers that score.

Counting: tasks turn texts into word hashes and send, for each shard, the sorted distinct bigrams of a few million
tokens with their counts, so that a pair that is a third of all tokens is one row a task. A bigram's key is 32 bits of either word's
hash under a one-to-one mixing of 64 bits; shards are ranges of the mixed key, even whatever words are frequent. A
shard's task merges its keys, writes them as a sorted array with counts, and sends per-word statistics (continuations after
and before a word) to the word shards, whose tasks write exact counts by the full 64-bit word hash and the statistics by
its upper half. The driver gets one row of totals a shard. Scoring maps the files and looks up sorted unique keys by
binary search. Shards are about as many as a quarter of the square root of the rows.

score: log10 probability of the words and the end under the model; base_score: add-one unigram. The orders' discounts come from counts
of counts; the lowest order is interpolated with the uniform distribution over known words and one unknown.

Defined results: a null or empty text is its end alone; with no training rows all scores are those of a uniform model over one word;
rows repeated count as often as they come; texts are read whole; a null id belongs to training as the empty id text.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import root_buckets, shared_dir, table
from linkloom.shared_files import mapped, save

#: Tokens that a task gathers before it sends their counts.
FLUSH = 2_000_000
#: Tokens that are scored at a time.
STEP = 400_000
CACHE = 400_000
END, START = b"\n", b"\r"  # no words: words hold no white space
FOLDS, HELD_OUT = 7, 2
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _unshift(x: np.ndarray, n: int) -> np.ndarray:
    out = x.copy()
    for _ in range(64 // n):
        out = x ^ (out >> np.uint64(n))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    x = _unshift(x, 31) * np.uint64(pow(int(_M2), -1, 1 << 64))
    x = _unshift(x, 27) * np.uint64(pow(int(_M1), -1, 1 << 64))
    return _unshift(x, 30)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hash = _Hashes()


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the start, the words (A-Z lower-cased) and the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_hash.__getitem__, [START, *words, END]), np.uint64, len(words) + 2)


def _pair_keys(seq: np.ndarray) -> np.ndarray:
    """Mixed keys of the sequence's neighbours."""
    high = seq & np.uint64(0xFFFFFFFF00000000)
    return mix(high[:-1] | (seq[1:] >> np.uint64(32)))


def _shard_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range starts in sorted keys, and the end."""
    edges = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


def _merged(keys: list[bytes], counts: list[bytes], of=np.uint64, counted=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    k, n = np.frombuffer(b"".join(keys), of), np.frombuffer(b"".join(counts), counted).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def _packed(n: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes, with those from 255 apart."""
    large = np.flatnonzero(n >= 255)
    return {"count": np.minimum(n, 255).astype(np.uint8), "large_at": large.astype(np.int64), "large": n[large].astype(np.int64)}


def _unpacked(f: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    out = f["count"][at].astype(np.int64)
    big = np.flatnonzero(out == 255)
    if len(big):
        out[big] = f["large"][np.searchsorted(f["large_at"], at[big])]
    return out


def _held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def build(docs: DataFrame, shards: int, folder: str) -> dict:
    """Counts the training rows of docs (doc_id, text) into files of the folder; the totals that scoring needs."""

    def count(batches):
        names = ["shard", "kind", "keys", "counts"]

        def flush(parts):
            seq = np.concatenate(parts)
            pair = _pair_keys(seq)
            pair = pair[seq[:-1] != end_hash]  # not from one text to the next
            for kind, k in (("b", pair), ("u", seq[seq != start_hash])):
                k, n = np.unique(k, return_counts=True)
                cuts = _shard_cuts(k, shards)
                n = n.astype(np.uint32)
                rows = [(s, kind, k[a:b].tobytes(), n[a:b].tobytes()) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary(), pa.binary()))], names)

        parts, size = [], 0
        end_hash, start_hash = np.uint64(_hash[END]), np.uint64(_hash[START])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not _held_out(doc_id):
                    parts.append(tokens(text))
                    size += len(parts[-1])
                    if size >= FLUSH:
                        yield from flush(parts)
                        parts, size = [], 0
        if parts:
            yield from flush(parts)

    def merge(key, pdf):
        import pandas as pd

        out = []
        of = lambda kind, c: pdf.loc[pdf["kind"] == kind, c].tolist()
        k, n = _merged(of("b", "keys"), of("b", "counts"), counted=np.uint32)
        save(folder, f"pairs-{key[0]}", {"key": k} | _packed(n))
        by = np.bincount(np.minimum(n, 5), minlength=6)
        pair = unmix(k)
        for kind, word, what in (("after", pair >> np.uint64(32), np.minimum(n, 3)), ("before", pair & np.uint64(0xFFFFFFFF), np.ones(len(n), np.int64))):
            word = word.astype(np.uint32)
            order = np.argsort(word, kind="stable")
            word, what = word[order], what[order]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, np.int64)
            sums = [np.add.reduceat((what == v).astype(np.int64), first) if len(word) else np.empty(0, np.int64) for v in ((1, 2, 3) if kind == "after" else (1,))]
            word = word[first]
            cuts = _shard_cuts(word.astype(np.uint64) << np.uint64(32), shards)
            out += [(s, kind, word[a:b].tobytes(), b"".join(x[a:b].tobytes() for x in sums)) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        k, n = _merged(of("u", "keys"), of("u", "counts"), counted=np.uint32)  # of a flush
        # a word of the exact table goes where the upper half of its hash goes
        cuts = _shard_cuts(k & np.uint64(0xFFFFFFFF00000000), shards)
        out += [(s, "exact", k[a:b].tobytes(), n[a:b].tobytes()) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        out.append((key[0], "totals", by.astype(np.int64).tobytes(), b""))
        return pd.DataFrame(out, columns=["shard", "kind", "keys", "counts"])

    def words(key, pdf):
        import pandas as pd

        of = lambda kind, c: pdf.loc[pdf["kind"] == kind, c].tolist()
        k, n = _merged(of("exact", "keys"), of("exact", "counts"))
        a_keys = of("after", "keys")
        split = [np.frombuffer(c, np.int64).reshape(3, -1) for c in of("after", "counts")]
        after = [_merged(a_keys, [c[v].tobytes() for c in split], np.uint32) for v in range(3)]
        b_key, before = _merged(of("before", "keys"), of("before", "counts"), np.uint32)
        half = np.union1d(after[0][0], b_key)
        arrays = {"word": k} | _packed(n) | {"half": half}
        for v in range(3):
            arrays[f"after{v + 1}"] = _spread(half, *after[v])
        arrays["before"] = _spread(half, b_key, before)
        save(folder, f"words-{key[0]}", arrays)
        pairs = sum((np.frombuffer(x, np.int64) for x in of("totals", "keys")), np.zeros(6, np.int64))
        cont = np.bincount(np.minimum(before, 5), minlength=6)
        row = {"tokens": int(n.sum()), "kinds": len(k), "pairs": int(before.sum()), "conts": len(before)}
        return pd.DataFrame([row | {f"p{i}": int(pairs[i]) for i in range(1, 5)} | {f"c{i}": int(cont[i]) for i in range(1, 5)}])

    blobs = "shard int, kind string, keys binary, counts binary"
    # every shard writes its files, also one without keys: a file that is missing is a loss, not an empty shard
    every = docs.sparkSession.range(0, shards, 1, min(shards, 8)).select(F.col("id").cast("int").alias("shard"), F.lit("").alias("kind"), F.lit(b"").alias("keys"), F.lit(b"").alias("counts"))
    counted = docs.select("doc_id", "text").mapInArrow(count, blobs).unionByName(every).groupBy("shard").applyInPandas(merge, blobs)
    totals = "tokens long, kinds long, pairs long, conts long, " + ", ".join(f"{x}{i} long" for x in "pc" for i in range(1, 5))
    found = counted.groupBy("shard").applyInPandas(words, totals).agg(*[F.sum(c).alias(c) for c in [x.split()[0] for x in totals.split(", ")]]).first()
    return {k: int(v or 0) for k, v in found.asDict().items()}


def _spread(keys: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), np.int64)
    out[np.searchsorted(keys, k)] = n
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more, from counts of counts; plain ones where these are missing."""
    if not (n1 and n2):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return np.array([0.0] + [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d[1:], 1)])


class Model:
    """The mapped model in a worker."""

    def __init__(self, folder: str, shards: int, totals: dict):
        self.folder, self.shards, self.t = folder, shards, totals
        self.files: dict[str, dict] = {}
        self.d2 = discounts(*(totals[f"p{i}"] for i in range(1, 5)))
        self.d1 = discounts(*(totals[f"c{i}"] for i in range(1, 5)))
        t = totals
        left = t["conts"] - t["c1"] - t["c2"]
        self.floor = (float(self.d1[1] * t["c1"] + self.d1[2] * t["c2"] + self.d1[3] * left) / t["pairs"] if t["pairs"] else 1.0) / (t["kinds"] + 1)
        self.start = np.uint64(_hash[START])

    def _file(self, name: str) -> dict:
        if name not in self.files:
            self.files[name] = mapped(self.folder, name)
        return self.files[name]

    def _look(self, keys: np.ndarray, ranges: np.ndarray, kind: str, column: str, want: dict[str, np.ndarray]) -> None:
        """Fills want for sorted unique keys, a shard at a time."""
        cuts = _shard_cuts(ranges, self.shards)
        for s in np.flatnonzero(np.diff(cuts)):
            f = self._file(f"{kind}-{s}")
            if not len(f[column]):
                continue
            own = keys[cuts[s] : cuts[s + 1]]
            at = np.searchsorted(f[column], own)
            at[at == len(f[column])] = 0
            hit = np.flatnonzero(f[column][at] == own)
            for k, out in want.items():
                out[cuts[s] + hit] = _unpacked(f, at[hit]) if k == "count" else f[k][at[hit]]

    def score(self, seqs: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
        """(tokens, known tokens, base score, score) of each text."""
        seq = np.concatenate(seqs)
        kinds, back = np.unique(seq, return_inverse=True)
        c = np.zeros(len(kinds), np.int64)
        self._look(kinds, kinds & np.uint64(0xFFFFFFFF00000000), "words", "word", {"count": c})
        half = kinds >> np.uint64(32)
        stats = {k: np.zeros(len(kinds), np.int64) for k in ("after1", "after2", "after3", "before")}
        self._look(half.astype(np.uint32), half << np.uint64(32), "words", "half", stats)
        t = self.t
        low = (stats["before"] - self.d1[np.minimum(stats["before"], 3)]) / max(t["pairs"], 1) + self.floor
        total = c.copy()
        total[kinds == self.start] = t["starts"]
        rest = (self.d2[1] * stats["after1"] + self.d2[2] * stats["after2"] + self.d2[3] * stats["after3"]) / np.maximum(total, 1)
        rest[total == 0] = 1.0
        pair, pair_back = np.unique(_pair_keys(seq), return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        self._look(pair, pair, "pairs", "key", {"count": n})
        n = n[pair_back]
        first, then = back[:-1], back[1:]
        p = (n - self.d2[np.minimum(n, 3)]) / np.maximum(total[first], 1) + rest[first] * low[then]
        logs = np.log10(p)
        base = np.log10((c[then] + 1) / (t["tokens"] + t["kinds"] + 1))
        known = c[then] > 0
        out, at = [], 0
        for s in seqs:
            a, b = at, at + len(s) - 1  # what stands before a text's start isn't its own
            out.append((b - a, int(known[a:b].sum()), float(base[a:b].sum()), float(logs[a:b].sum())))
            at += len(s)
        return out


def score(docs: DataFrame, shards: int, folder: str, totals: dict) -> DataFrame:
    def run(batches):
        model = Model(folder, shards, totals)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, part, size = [], [], 0
            for k, text in enumerate(texts):
                part.append(tokens(text))
                size += len(part[-1])
                if size >= STEP or k + 1 == len(texts):
                    rows += model.score(part)
                    part, size = [], 0
            n, known, base, logs = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_held_out(i) for i in ids], pa.bool_()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([totals["tokens"]] * len(ids), pa.int64()), pa.array(base, pa.float64()), pa.array(logs, pa.float64())],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    is_held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT
    seen = docs.agg(F.count("*").alias("n"), F.count(F.when(~is_held, 1)).alias("train")).first()
    shards = max(4, root_buckets(seen["n"]) // 4)
    folder = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    totals = build(docs, shards, folder) | {"starts": int(seen["train"])}
    return score(docs, shards, folder, totals)
