import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.operators import decide, fusion, learn, metrics, mining, retrieval, validate
from linkloom.plans import linkage
from linkloom.sources import tables


def test_f_beta(spark):
    rows = [(0, 0, 0), (0, 1, 0), (1, 2, 2), (2, 3, 2)]
    df = spark.createDataFrame(rows, "h int, p int, g int")
    assert [round(r[0], 3) for r in df.select(metrics.f_beta(F.col("h"), F.col("p"), F.col("g"))).collect()] == [1.0, 0.0, 0.5, 0.714]


def test_rrf_first_is_in_both(spark):
    rows = [("q", f"d{c}", n, r) for n, ids in (("a", [1, 2, 3]), ("b", [2, 9, 8])) for r, c in enumerate(ids, 1)]
    got = fusion.rrf(spark.createDataFrame(rows, "query_id string, cand_id string, list_name string, rank int")).orderBy("rank").first()
    assert got["cand_id"] == "d2" and abs(got["rrf"] - (1 / 62 + 1 / 61)) < 1e-9


def test_choose_keep():
    assert fusion.choose_keep([{5: 0.9, 25: 0.99, 100: 1.0}, {5: 0.99, 25: 1.0, 100: 1.0}]) == 25


def test_keep_and_mapping(spark):
    s2, s3 = [0.99, 0.98, 0.97, 0.96, 0.95], [0.99, 0.5, 0.4]
    rows = [("A", f"S2-{i}", 2, p) for i, p in enumerate(s2)] + [("A", f"S3-{i}", 3, p) for i, p in enumerate(s3)]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, source int, p double")
    rule = {"threshold": 0.5, "alpha": 0.0, "gate": 0.0, "cap": 2}
    kept = {r["cand_id"] for r in decide.pack(df).where(decide.keep(rule)).collect()}
    assert kept == {"S2-0", "S2-1", "S3-0", "S3-1"}
    two = spark.createDataFrame([("A", "x", 2, 0.9), ("B", "x", 2, 0.85), ("C", "y", 2, 0.5), ("B", "y", 2, 0.5)], df.schema)
    assert {(r["s1_id"], r["cand_id"]) for r in decide.unique_mapping(two).collect()} == {("A", "x"), ("B", "y")}


def test_unique_mapping_is_the_greedy_one(spark):
    rnd = random.Random(1)
    rows = [(f"A{rnd.randrange(5)}", f"x{rnd.randrange(6)}", 2, rnd.choice([0.1, 0.5, 0.9])) for _ in range(60)]
    rows = list({(a, b): (a, b, s, p) for a, b, s, p in rows}.values())
    taken = {}
    for a, b, _, p in sorted(rows, key=lambda r: (-r[3], r[0])):
        taken.setdefault(b, a)
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, source int, p double")
    assert {r["cand_id"]: r["s1_id"] for r in decide.unique_mapping(df).collect()} == taken


def test_macro_counts_entities_without_candidates(spark):
    e = spark.createDataFrame([("A",), ("B",), ("C",)], "s1_id string")
    pairs = lambda rows: spark.createDataFrame(rows, "s1_id string, cand_id string")
    got = metrics.macro(metrics.entity_scores(metrics.entity_counts(e, pairs([("A", "x")]), pairs([("A", "x"), ("B", "z")])))).first()
    assert got["entities"] == 3 and abs(got["macro_f05"] - 2 / 3) < 1e-6 and got["singleton_accuracy"] == 1.0


def test_temperature(spark):
    rows = spark.createDataFrame([(4.0, 1.0), (-4.0, 0.0), (4.0, 0.0), (-4.0, 1.0)] + [(4.0, 1.0), (-4.0, 0.0)] * 8, "logit double, label double")
    t = learn.fit_temperature(rows)
    assert 0 < t < 100
    p = [r[0] for r in rows.select(learn.probability(F.col("logit"), t)).collect()]
    assert abs(max(p) - 0.9) < 0.02


def test_majority_and_claimants(spark):
    df = spark.createDataFrame([("a", "x")] * 3 + [("a", "y")] + [("b", "y")], "k string, v string")
    assert [tuple(r) for r in mining.majority(df, "k", "v", 2, 0.5).collect()] == [("a", "x", 3)]
    s1 = spark.createDataFrame([("1", "prime food house"), ("2", "prime food"), ("3", "food")], "s1_id string, name string")
    c = spark.createDataFrame([("prime food",), ("food zebra",), ("the ltd",), ("",)], "name string")
    assert {r["name"]: r["claimants"] for r in mining.name_claimants(c, s1).collect()} == {"prime food": 2, "food zebra": 0, "the ltd": 0, "": 0}


def test_dense_topk_is_exact_over_blocks(spark):
    import numpy as np

    v = np.random.default_rng(0).standard_normal((40, 6))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vec array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -9)
    got = retrieval.dense_topk(df, df, "id", "vec", 3, block=7)
    assert {(r["query_id"], r["rank"], r["cand_id"]) for r in got.collect()} == {(i, k + 1, int(c)) for i in range(40) for k, c in enumerate(np.argsort(-cos[i])[:3])}


def test_postings_drop_common_keys(spark):
    q = spark.createDataFrame([("q", ["a", "b"])], "id string, ks array<string>")
    d = spark.createDataFrame([(f"d{i}", ["a"]) for i in range(4)] + [("d9", ["b"])], "id string, ks array<string>")
    got = retrieval.postings_topk(q, "id", F.col("ks"), d, "id", F.col("ks"), 5, max_df=3)
    assert [r["cand_id"] for r in got.collect()] == ["d9"]


def test_validation(spark):
    rows = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-2", "S1-3"), ("S1-2", ""), ("S1-9", "X")], "s1_id string, ids string")
    known = spark.createDataFrame([("S2-1",)], "id string")
    want = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1_id string")
    got = {r["rule"]: r["n"] for r in validate.check_lists(rows, want, known).collect()}
    assert got == {"duplicate_id": 1, "self_match": 1, "duplicate_row": 1, "wrong_prefix": 1, "missing_entity": 1, "extra_entity": 1, "unknown_id": 2}


def test_sources(spark, tmp_path):
    path = tmp_path / "train_source1.tsv"
    path.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t Acme \"x\" \t\tIN\nS1-2\tB\tc, d\tUS\n")
    assert [r["business_name"] for r in tables.read_source(spark, str(path)).orderBy("entity_id").collect()] == ['Acme "x"', "B"]
    path.write_text(path.read_text() + "S1-1\tC\td\tUS\n")
    with pytest.raises(Exception, match="repeated id"):
        tables.read_source(spark, str(path)).collect()
    assert tables.read_source(spark, str(path), strict=False).count() == 3
    path.write_text("entity_id,business_name\n")
    with pytest.raises(ValueError, match="no column"):
        tables.read_source(spark, str(path))
    df = spark.createDataFrame([("a, b,,c, a",), (None,)], "s string")
    assert [r[0] for r in df.select(tables.parse_ids("s")).collect()] == [["a", "b", "c", "a"], []]


def test_score_shards_resume(spark, tmp_path):
    pairs = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(20)], "s1_id string, cand_id string")
    seen = []

    def score(df):
        seen.append(df.count())
        return df.withColumn("p", F.lit(0.5))

    for _ in range(2):
        assert tables.score_shards(pairs, str(tmp_path / "scores"), score, 4).count() == 20
    assert sum(seen) == 20 and len(seen) == 4


def test_score_shards_after_a_lost_run(spark, tmp_path):
    """A run that fails keeps the shards that it has finished; one that it hasn't, half written, is written anew."""
    pairs = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(40)], "s1_id string, cand_id string")
    path, seen = str(tmp_path / "scores"), []

    def score(df):
        seen.append(df.count())
        if len(seen) == 3:
            raise RuntimeError("lost")
        return df.withColumn("p", F.lit(0.5))

    with pytest.raises(RuntimeError):
        tables.score_shards(pairs, path, score, 4)
    (tmp_path / "scores" / "shard=3").mkdir()
    (tmp_path / "scores" / "shard=3" / "part-0.parquet").write_text("half")
    assert sorted(r["s1_id"] for r in tables.score_shards(pairs, path, score, 4).collect()) == sorted(f"S1-{i}" for i in range(40))
    assert len(seen) == 5


def test_select_a_takes_the_best_of_a_repeated_pair(spark):
    rows = [("a", "x", 2, 0.2), ("a", "x", 2, 0.9), ("a", "y", 2, 0.5), ("a", "y", 2, 0.1)]
    got = decide.select_a(spark.createDataFrame(rows, "s1_id string, cand_id string, source int, p double"), 0.4, 0.5, 0.1, 5)
    assert sorted((r["cand_id"], r["p"]) for r in got.collect()) == [("x", 0.9), ("y", 0.5)]


def test_segments_by_all_unigrams(spark):
    # more words than any bound on the vocabulary; the rarest two make the stem
    counts = {f"w{i}": 3 for i in range(6000)} | {"zorp": 1, "quax": 1}
    df = spark.createDataFrame(list(counts.items()), "token string, n long")
    got = mining.segments(spark.createDataFrame([("zorpquax",), ("w17zorp",), ("",)], "stem string"), df).collect()
    assert {r["stem"]: r["words"] for r in got} == {s: " ".join(text.segment(s, counts, sum(counts.values()))) for s in ("zorpquax", "w17zorp", "")}
    assert {r["stem"]: r["words"] for r in got}["zorpquax"] == "zorp quax"


SF = "/root/testdata/sf0.001"


def test_viterbi_and_model_one_take_all_tokens(spark):
    names = [re.findall("[a-z0-9]+", r["name"].lower()) for r in linkage.records(spark, SF).select("name").collect()]
    counts = Counter(t for ts in names for t in ts if len(t) >= 2)
    got = {r["stem"]: r["words"] for r in linkage.QUERIES["viterbi_segment"](spark, SF).collect()}
    assert got and all(w == " ".join(text.segment(s, counts, sum(counts.values()))) for s, w in got.items())
    pairs = [(ts[:-1], ts[1:]) for ts in ([re.findall("[a-z0-9]+", r["name"].lower()) for r in linkage.records(spark, SF).where("source = 1").select("name").collect()]) if len(ts) >= 2]
    p = defaultdict(lambda: 1.0)
    for _ in range(6):
        share, total = defaultdict(float), defaultdict(float)
        for left, right in pairs:
            for n in right:
                z = sum(p[x, n] for x in set(left))
                for x in left:
                    share[x, n] += p[x, n] / z
        for (x, _), v in share.items():
            total[x] += v
        p = defaultdict(float, {k: v / total[k[0]] for k, v in share.items()})
    got = {(r["l"], r["n"]): r["p"] for r in linkage.QUERIES["model1_em"](spark, SF).collect()}
    assert set(got) == set(p) and all(abs(v - p[k]) < 2e-6 for k, v in got.items())


def test_span_tags_of_every_event(spark):
    def tag(s):
        s = re.sub("(?<![0-9])([0-9]{5,6})(?![0-9])", r"[ZIP] \1 [/ZIP]", s or "")
        return re.sub(r"^((?:(?!\[ZIP\])[^0-9])*)([0-9]+[A-Za-z]?)(?![0-9])", r"\1[NUM] \2 [/NUM]", s)

    sf = "/root/testdata/sf0.1"
    want = {r["event_id"]: tag(r["props"]) for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id", "props").collect()}
    got = linkage.QUERIES["span_tags"](spark, sf).collect()
    assert len(got) == len(want) == 100_000 and {r["event_id"]: r["tagged"] for r in got} == want and any("[" in t for t in want.values())


def test_names_of_any_script(spark, tmp_path):
    texts = ["Việt Nam cà phê một hai", "Việt Nam cà phê một ba", "Nam Việt phê cà bốn", "Ωμέγα ήλιος x² ½ ŵ", "Ωμέγα ήλιος x² ŵ", "ήλιος Ωμέγα ½"]
    spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    names = {r["id"]: r["name"] for r in linkage.records(spark, str(tmp_path)).collect()}
    plain = lambda s: " ".join("".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).split())
    got = {r["id"]: r["plain"] for r in linkage.QUERIES["strip_diacritics"](spark, str(tmp_path)).collect()}
    assert got == {i: plain(s) for i, s in names.items()}

    def jaro_winkler(a, b):
        # a letter of a takes the first free equal letter of b within reach
        reach, free, mine = max(len(a), len(b)) // 2 - 1, list(range(len(b))), []
        for i, c in enumerate(a):
            j = next((j for j in free if abs(i - j) <= reach and b[j] == c), None)
            if j is not None:
                free.remove(j)
                mine.append((i, j))
        if not mine:
            return 0.0
        m, t = len(mine), sum(a[i] != b[j] for (i, _), j in zip(mine, sorted(j for _, j in mine))) // 2
        jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
        same = next((k for k in range(4) if a[k : k + 1] != b[k : k + 1] or k >= len(a)), 4)
        return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro

    pairs = {(r["s1_id"], r["c_id"]) for r in linkage.pairs(spark, str(tmp_path)).collect()}
    got = {(r["s1_id"], r["c_id"]): r["jw"] for r in linkage.QUERIES["jaro_winkler"](spark, str(tmp_path)).collect()}
    assert set(got) == pairs and any(not names[a].isascii() for a, _ in pairs)
    assert all(abs(v - jaro_winkler(names[a], names[b])) < 2e-6 for (a, b), v in got.items())


def test_block_jaccard_of_all_pairs_over_tiles(spark):
    """Equal texts, nulls, short and empty ones, a repeated key and a half to be rounded up, in blocks of one and of many tiles."""
    rnd = random.Random(5)
    long = "".join(chr(0x4E00 + i) for i in range(67))  # 65 n-grams, one of 128 in common with the next
    names = ["", " ", "ab", "a b", "abc", "abcd", None, "Việt Nam", "forest green", "green forest", long, long[-3:] + "".join(chr(0x5E00 + i) for i in range(63))]
    rows = [(i, rnd.choice(names), "b" if i % 3 else "c", 1) for i in range(60)] + [(7, "abcd", "b", 1), (90, "ab", None, 1), (None, "ab", "b", 1), (91, "alone", "z", 2)]
    rows += [(100 + i, t, "d", 1) for i, t in enumerate(names)]
    df = spark.createDataFrame(rows, "k int, t string, x string, y int").repartition(3)
    p, q = df.alias("p"), df.alias("q")
    from linkloom.functions import similarity as S

    want = p.join(q, ["x", "y"]).where("p.k < q.k").select(F.col("p.k"), F.col("q.k"), F.round(S.jaccard(S.char_ngrams(F.col("p.t")), S.char_ngrams(F.col("q.t"))), 6))
    want = Counter(tuple(r) for r in want.collect())
    assert (110, 111, 0.007813) in want
    for tile in (4, 1024):
        got = retrieval.block_jaccard(df, "k", "t", ["x", "y"], tile=tile)
        assert Counter(tuple(r) for r in got.collect()) == want and [t for _, t in got.dtypes] == ["int", "int", "double"]


def test_trigram_jaccard_compares_equal_names_once(spark):
    """Copies of names made each pair of copies a comparison of its own."""
    plan = linkage.QUERIES["trigram_jaccard"](spark, SF)._jdf.queryExecution().toString()
    assert "array_intersect" not in plan and "FlatMapGroupsInArrow" in plan
