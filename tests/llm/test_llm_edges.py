"""Null, empty, very long, tied and repeated rows, empty tables and extra columns with clashing names, for every operator and stage."""

import numpy as np
import pytest

import corpus_pipeline
from linkloom.llm import bpe, html, lm, near_dup, packing, quality, sharding, toxicity, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component string, rank int, size int"
LONG = " ".join(f"w{k}" for k in range(30_000))
ROWS = [
    (1, None, "en", None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", None, "a", 3),
    (4, LONG, "en", "a", len(LONG)),
    (5, "same words here again", "en", "b", 1),
    (6, "same words here again", "en", "b", 1),
    (6, "same words here again", "en", "b", 1),
    (None, "no id at all", "en", "b", 1),
    (7, "X" * 5000, "en", "c", 1),
]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for name, rows, labels in (("full", ROWS, [(4, 1, 0), (5, 0, 1), (6, 0, 1), (6, 1, 0), (None, 1, 1), (7, None, None)]), ("empty", [], [])):
        d = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame([(*r, True, "x", 1, 1) for r in rows], DOCS).coalesce(1).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels, LABELS).coalesce(1).write.parquet(f"{d}/labels.parquet")
        pages = [(1, None, None), (2, "no scheme", ""), (3, "HTTP://User@Example.ORG:80?q", "<p>a<p>b" + "<div>" * 3000), (3, "HTTP://User@Example.ORG:80?q", "<p>a<p>b")] if rows else []
        spark.createDataFrame([(*p, "h", "p", 0.5) for p in pages], "page_id long, url string, html string, host string, path string, score double").coalesce(1).write.parquet(f"{d}/pages.parquet")
        nan, inf = float("nan"), float("inf")
        vecs = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0, 0.1]), (9, [1.0, 0.1]), (10, [1e-200, 0.0]), (11, [1.0, 0.0, 0.0])] if rows else []
        spark.createDataFrame([(i, v, 0, "x") for i, v in vecs], "vec_id long, embedding array<double>, label int, id string").coalesce(1).write.parquet(f"{d}/embeddings.parquet")
        out[name] = d
    return out


DOC_QUERIES = [lm.op1_lm_scoring, sharding.op2_sharding, packing.op3_packing, toxicity.op6_toxicity, near_dup.op7_near_dup, bpe.op9_bpe, quality.op10_quality_rules]


@pytest.mark.parametrize("query", DOC_QUERIES, ids=lambda q: q.__name__)
def test_documents(spark, folders, query):
    assert query(spark, folders["empty"]).count() == 0
    got = query(spark, folders["full"]).toPandas()
    if query is packing.op3_packing:
        assert got["length"].sum() == got.drop_duplicates(["doc_id", "doc_tokens"])["doc_tokens"].sum() + 2 * got.loc[got["doc_id"] == 6, "doc_tokens"].iloc[0] - got.loc[got["doc_id"] == 6, "doc_tokens"].iloc[0]
        assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    else:
        assert sorted(got["doc_id"].fillna(-1)) == sorted(-1 if r[0] is None else r[0] for r in ROWS)


def test_urls(spark, folders):
    assert urls.op4_url_filters(spark, folders["empty"]).count() == 0
    got = urls.op4_url_filters(spark, folders["full"]).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got[:2]] == [("", "", None, "allow")] * 2
    assert got[2]["host"] == "user@example.org:80" and got[2]["path"] == "" and len(got) == 4


def test_html(spark, folders):
    assert html.op8_html_extraction(spark, folders["empty"]).count() == 0
    got = html.op8_html_extraction(spark, folders["full"]).orderBy("page_id").collect()
    assert [(r["text"], r["n_chars"]) for r in got] == [("", 0), ("", 0), ("a b", 3), ("a b", 3)]


def test_vectors(spark, folders):
    assert vectors.op5_embedding_near_dup(spark, folders["empty"]).count() == 0
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.op5_embedding_near_dup(spark, folders["full"]).collect())
    lone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6)]
    assert got == [*lone, (7, 4, 7, True), (8, 4, 7, False), (9, 4, 7, False), (9, 4, 7, False), (10, 4, 7, False), (11, 0, 11, True)]


def test_pipeline(spark, folders):
    assert corpus_pipeline.run(spark, folders["empty"]).count() == 0
    docs = spark.read.parquet(folders["full"] + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folders["full"])
        assert kept.columns == docs.columns, name
        ids = {r["doc_id"] for r in kept.collect()}
        if name == "near_dup":
            assert 5 in ids and 6 not in ids and None in ids
    assert corpus_pipeline.run(spark, folders["full"]).where("length > 0").count() > 0


def test_an_id_of_two_texts_and_rows_without_an_id(spark):
    text = lambda p: " ".join(f"{p}{k}" for k in range(12))
    a, b, q = text("a"), text("b"), text("q")
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (None, a), (None, q), (7, q + " r"), (8, ""), (8, None), (None, ""), (None, text("n"))]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {(1, 11, 1, True), (2, 12, 1, False), (3, 12, 1, False), (None, 11, 1, False), (None, 11, 7, False), (7, 12, 7, True), (8, 0, 8, True), (None, 0, None, True), (None, 11, None, True)}


def test_quality_stage_hands_clashing_columns_on(spark, folders):
    docs = spark.createDataFrame([(1, LONG, False, "mine", -1, "t")], "doc_id long, text string, kept boolean, rule string, n_words int, _q_t string")
    assert [tuple(r) for r in quality.stage(spark, docs, folders["full"]).collect()] == [(1, LONG, False, "mine", -1, "t")]


def test_packing_doesnt_depend_on_the_order_of_rows(spark):
    rows = [(5, "x y")] * 20 + [(None, None)] * 3 + [(k, " ".join(f"w{k} {j}" for j in range(k))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    packed = lambda d: sorted(map(str, packing.pack(d, len(rows), group_docs=20).collect()))
    assert packed(df) == packed(df.orderBy("text").repartition(7)) and len(packed(df)) >= len(rows)


def test_packing_encodes_a_piece_once(monkeypatch):
    """Every spelling of a word between spaces went through the whole tokenizer."""
    encoder = packing.ChunkEncoder(packing.vocabulary_path(packing.VOCABULARY))
    whole, pieces = [], []
    monkeypatch.setattr(encoder, "encode", lambda new, f=encoder.encode: (whole.extend(new), f(new)))
    monkeypatch.setattr(encoder, "encode_pieces", lambda new, f=encoder.encode_pieces: (pieces.extend(new), f(new)))
    texts = ["Straße, straße. STRAßE; straße\nStraße.", "the “straße”, straße", "<|endoftext|> Straße"]
    got = [i for t in texts for i in encoder.ids([t])]
    assert got == [np.array(encoder.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert sorted(pieces) == sorted([",", ".", ";", "straße", "the"]) and sorted(whole) == sorted(["“straße”,", "<|endoftext|>"])


def test_packing_has_the_tokenizers_ids():
    encoder = packing.ChunkEncoder.of(packing.vocabulary_path(packing.VOCABULARY))
    one = [chr(k) for k in range(0x180)]
    texts = one + [f"A{c}b{c}{c}'s{c} {c}'LL1{c}2. ,{c}, {c}" for c in one] + [f"{c}{d}" for c in one[0x80:0x100] for d in "'.1a \u0301"]
    texts += ["", " ", "a.. b., c", "<|startoftext|><|ENDOFTEXT|>A", "ΑΣ Σ σς İı K ﬁ", "日本 e\u0301 \u00ad"]
    want = [np.array(encoder.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(encoder.ids(texts)) == want and [i for t in texts for i in encoder.ids([t])] == want


def test_lm_fails_without_a_shard(spark, tmp_path):
    import os

    df = spark.createDataFrame([(k, f"word{k} and") for k in range(20)], "doc_id long, text string")
    totals = lm.build(df, 6, str(tmp_path)) | {"starts": 20}
    assert {f"{k}-{s}" for k in ("pairs", "words") for s in range(6)} <= set(os.listdir(tmp_path))
    assert lm.score(df, 6, str(tmp_path), totals).count() == 20
    for s in range(6):
        os.remove(tmp_path / f"words-{s}")
    with pytest.raises(Exception, match="words-"):
        lm.score(df, 6, str(tmp_path), totals).collect()


def test_counts_beyond_32_bits():
    k, n = lm._merged([np.array([7, 9], np.uint64).tobytes()] * 3, [np.array([3 << 31, 1], np.int64).tobytes()] * 3)
    assert k.tolist() == [7, 9] and n.tolist() == [9 << 31, 3]


def test_components_of_a_path_and_a_star(spark):
    from linkloom.llm.components import components

    edges = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 140)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {k: 100 for k in range(100, 140)}


def test_discounts_without_counts():
    assert lm.discounts(0, 0, 0, 0).tolist() == [0, 0.5, 0.5, 0.5]
    x = np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (lm.unmix(lm.mix(x)) == x).all()


def test_pipeline_workers_give_back_what_they_held(spark, monkeypatch):
    """Idle workers of the pipeline's packing kept up to 800,000 chunks each through all later stages."""
    import gc
    import weakref

    from linkloom.llm import packing
    from linkloom.llm.common import lean

    class Held:
        pass

    seen = []

    def run(batches):
        held = Held()
        seen.append(weakref.ref(held))
        yield from batches

    assert list(lean(run)([1, 2])) == [1, 2]
    gc.collect()
    assert seen[0]() is None
    docs = spark.createDataFrame([(i, f"alpha beta {i}") for i in range(40)], "doc_id long, text string")
    assert sorted(packing.pack(docs, 40).collect()) == sorted(packing.pack(docs, 40, remember=False).collect())
    asked = {}
    monkeypatch.setattr(packing, "pack", lambda *a, **b: asked.update(b))
    packing.stage(spark, docs, "")
    assert asked == {"remember": False}
