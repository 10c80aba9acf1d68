from pyspark.sql import functions as F

from linkloom.functions import translit as R
from linkloom.operators import decide, features, retrieval


def test_syllables():
    for word in ("प्राइवेट", "ప్రైవేట్", "abc", "प्राइम1"):
        parts = R.syllables(word)
        assert "".join(parts) == word
    assert len(R.syllables("प्राइवेट")) >= 2 and R.syllables(None) == []


def test_train_decode_snap(spark):
    pairs = spark.createDataFrame([("प्राइम", "prime"), ("प्राइवेट", "private"), ("फूड", "food")] * 3, "native string, latin string")
    table = R.train(pairs, 3)
    assert abs(sum(p for (u, _), p in table.items() if u == "फू") - 1) < 1e-6 or not any(u == "फू" for u, _ in table)
    options = [("प्राइवेट", o, k) for k, o in enumerate(R.decode("प्राइवेट", table), 1)]
    words = spark.createDataFrame([(w,) for w in ("private", "limited", "food", "prime", "house")], "word string")
    got = R.snap(spark.createDataFrame(options, "token string, option string, rank int"), words).first()
    assert got["word"] == "private"


def test_stacker_matrix(spark):
    e = spark.createDataFrame([("S1-1", "prime food", "17 high street, x, y"), ("S1-2", "prime food house", "")], "id string, name string, address string")
    c = spark.createDataFrame([("S2-1", "food", "18 high street, x, y"), ("S2-2", "jaxpyra", "")], "id string, name string, address string")
    pairs = spark.createDataFrame([("S1-1", "S2-1", 2, 0.9), ("S1-1", "S2-2", 2, 0.4), ("S1-2", "S2-1", 2, 0.3)], "s1_id string, cand_id string, source int, p double")
    rows = features.claimant_features(decide.pack(pairs), e, c)
    rev = retrieval.reverse_topk(pairs.select(F.col("s1_id").alias("query_id"), "cand_id", F.col("p").alias("score")))
    got = {(r["s1_id"], r["cand_id"]): r for r in features.stacker_matrix(rows, rev).collect()}
    a = got["S1-1", "S2-1"]
    assert (a["name_claimants"], a["house_conflict"], a["name_prefix"], a["blank_address"], a["reverse_rank"]) == (2, 1, 1, 0, 1)
    b = got["S1-1", "S2-2"]
    assert (b["name_claimants"], b["nonce_like"], b["blank_address"]) == (0, 1, 1) and abs(b["gap_to_best"] - 0.5) < 1e-9
