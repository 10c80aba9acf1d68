"""Allow and block rules over a logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled URL table (`SEED` words put in host shapes, unless the
caller brings a table), and is WIDTH weights, whatever the size of the pages. Rules are Spark expressions. Each url is judged
for itself: no shuffle.

Defined results: a null url, or one without "://", has empty host and path, no rule, and the model's verdict on
nothing, which is the share of blocked rows in its table, so allow; repeated pages are judged one by one. Ports and
user names stay part of the host. A rule's length is that of its text; rules of one length are taken in their order.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import table

WIDTH = 1 << 16
GRAMS = (3, 4, 5)

#: (verdict, rule): host, then path from the first slash.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: Words of blocked and of allowed sites from which the labelled table is made.
BLOCK_WORDS = "casino poker slots jackpot betting gambling cheap pills pharma viagra loans payday spam farm win winner prize lottery xxx porn adult escort warez crack keygen torrent malware phishing clickbait replica bitcoin miracle ads tracker track popunder free bets".split()
ALLOW_WORDS = "news library museum science garden travel recipes weather music history city school college research journal archive health books maps sports docs code forum photo film theatre nature energy law market".split()
#: Frequent letter groups of English, of which further allowed hosts are made.
SYLLABLES = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce ing tion ble ment".split()
PREFIXES = ["", "www.", "m.", "blog."]
DOMAINS = ["example.com", "example.net", "example.org"]


def seed_table() -> list[tuple[str, int]]:
    """Labelled urls, 1: block. Allowed hosts also have invented names, so that unknown letters alone tell nothing."""
    out = []
    for k, w in enumerate(BLOCK_WORDS):
        v = BLOCK_WORDS[(k * 7 + 3) % len(BLOCK_WORDS)]
        out += [(f"http://{PREFIXES[k % 4]}{w}-{v}.{DOMAINS[k % 3]}/en/{k}", 1), (f"https://{PREFIXES[(k + 1) % 4]}{w}{v}.{DOMAINS[(k + 1) % 3]}/{w}/{k * 3}.html", 1), (f"https://{w}.{DOMAINS[(k + 2) % 3]}/{v}", 1)]
        out += [(f"https://{PREFIXES[n % 4]}{form.format(w)}.{DOMAINS[(k + n) % 3]}/{('en', 'fr', 'de', 'es')[n % 4]}/{k + n}", 1) for n, form in enumerate(("{}-x", "my-{}", "{}-24", "top{}", "{}-online", "the-{}-site"))]
    for k, w in enumerate(ALLOW_WORDS):
        v = ALLOW_WORDS[(k * 11 + 5) % len(ALLOW_WORDS)]
        out += [(f"http://{PREFIXES[k % 4]}{w}-{v}.{DOMAINS[k % 3]}/{('en', 'fr', 'de', 'es')[k % 4]}/{k}", 0), (f"https://{PREFIXES[(k + 1) % 4]}{w}{v}.{DOMAINS[(k + 1) % 3]}/{w}/{k * 3}.html", 0), (f"https://{w}.{DOMAINS[(k + 2) % 3]}/{v}", 0)]
    letters = np.random.default_rng(4)
    for k in range(4 * len(BLOCK_WORDS)):
        name = "".join(c + v for c, v in zip(letters.choice(list("bcdfghlmnprstvw"), 4), letters.choice(list("aeiou"), 4)))
        out.append((f"https://{PREFIXES[k % 4]}{name}.{DOMAINS[k % 3]}/{('en', 'fr', 'de', 'es')[k % 4]}/{k * 9}", 0))
    for k in range(8 * len(BLOCK_WORDS)):
        name = "".join(letters.choice(SYLLABLES, 2 + k % 3))
        out.append((f"http://{PREFIXES[k % 4]}{name}.{DOMAINS[k % 3]}/{('en', 'fr', 'de', 'es')[k % 4]}/{k * 7}", 0))
    return out


def split_url(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return host.encode().lower().decode(), rest[:cut]


def grams(kind: str, s: str, width: int) -> list[int]:
    """Hashes of the n-grams, each once."""
    data = f"^{s}$".encode()
    return list({zlib.crc32(data[k : k + n], ord(kind)) % width for n in GRAMS for k in range(len(data) - n + 1)}) if s else []


class UrlModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self._part = lru_cache(200_000)(lambda kind, s: float(self.weights[grams(kind, s, len(self.weights))].sum()))

    def __reduce__(self):
        return UrlModel, (self.weights, self.bias)

    def probability(self, host: str, path: str) -> float:
        z = self.bias + self._part("h", host) + self._part("p", path)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def train(rows: list[tuple[str, int]], width: int = WIDTH, rounds: int = 300, rate: float = 0.5, l2: float = 1e-3) -> UrlModel:
    """Full-batch gradient descent; a table with rows of one kind only gives that kind's share as the bias."""
    y = np.array([v for _, v in rows], float)
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
    w = np.zeros(width)
    if len(y) and 0 < y.sum() < len(y):
        feats = [[*grams("h", h, width), *grams("p", p, width)] for h, p in (split_url(u) for u, _ in rows)]
        row = np.repeat(np.arange(len(y)), [len(f) for f in feats])
        col = np.concatenate(feats).astype(np.int64)
        scale = rate / np.sqrt(max(1, len(col) / len(y)))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(y)) + bias, -60, 60)))
            w -= scale * (np.bincount(col, (p - y)[row], width) / len(y) * 10 + l2 * w)
    return UrlModel(w.astype(np.float32), bias)


def host_column(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_column(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: -len(r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, model: UrlModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score (probability of block) for pages (page_id, url)."""
    model = model or train(seed_table())

    def run(batches):
        for b in batches:
            scores = [model.probability(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(scores, pa.float64())], ["page_id", "host", "path", "score"])

    parts = pages.select("page_id", host_column(F.col("url")).alias("host"), path_column(F.col("url")).alias("path"))
    scored = parts.mapInArrow(run, "page_id long, host string, path string, score double")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), RULES if rules is None else rules)
    by_model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
