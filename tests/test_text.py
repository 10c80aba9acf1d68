import math

from pyspark.sql import functions as F

from linkloom.functions import similarity as S
from linkloom.functions import text as T


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "s string").select(column).collect()]


def test_clean_and_romanize():
    assert "null" not in T.clean_text("ACME <NULL> Inc.")
    assert T.clean_text("Straße,, , 5 !!") == "strasse, 5 !"
    assert T.romanize_text("Élan") == "elan"
    assert T.romanize_text(None) == ""
    assert "प्राइम".translate(T.brahmic_table()).isascii()


def test_segment():
    counts = {"maan": 100, "construction": 80, "private": 50, "limited": 50}
    assert T.segment("maanconstruction", counts, 280) == ["maan", "construction"]
    assert T.segment("", counts, 280) == []


def test_tokens_and_flags(spark):
    assert values(spark, ["Prime Food Private Limited", None], T.content_tokens("s")) == [["prime", "food"], []]
    assert values(spark, ["jaxpyra", "prime food private limited", None], T.is_nonce("s")) == [True, False, False]
    assert values(spark, ["www.maan-foods.com", "maan", None], T.domain_stem("s")) == ["maanfoods", "", ""]
    assert values(spark, ["प्राइम", "తెలుగు", "abc"], T.script_of("s")) == ["devanagari", "telugu", None]
    tagged = values(spark, ["221B Baker Street, 560001"], T.tag_numbers("s"))[0]
    assert "[NUM] 221B" in tagged and "[ZIP] 560001" in tagged


def test_address(spark):
    got = values(spark, ["17 r. villars, roubaix, nord", "", None, "007 high street"], T.parse_address("s"))
    assert (got[0]["house"], got[0]["city"], got[0]["state"]) == ("17", "roubaix", "nord")
    assert tuple(got[1]) == tuple(got[2]) == ("", "", "", "")
    assert got[3]["house"] == "7"


def test_summary_keeps_unknown_words(spark):
    idf = F.create_map(F.lit("alpha"), F.lit(1.0), F.lit("beta"), F.lit(1.0))
    assert values(spark, ["alpha beta देवनागरी gamma"], T.summarize_address("s", idf, 2)) == ["देवनागरी gamma"]


def test_normalize(spark):
    assert values(spark, ["Café & Sons Limited 007"], T.normalize("s")) == ["cafe and sons ltd 7"]


def test_similarity():
    assert math.isclose(S.jaro_winkler_of("MARTHA", "MARHTA"), 0.9611, abs_tol=1e-4)
    assert S.ratio_of("", "") == 100 and S.ratio_of("abcd", "abcf") == 75
    assert S.partial_ratio_of("abc", "xxabcxx") == 100
    assert S.lcs_length("AGGTAB", "GXTXAYB") == 4


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "x array<string>, y array<string>")
    assert [round(r[0], 4) for r in df.select(S.jaccard(F.col("x"), F.col("y"))).collect()] == [0.3333, 1.0, 0.0]


def test_wrong_before(spark):
    assert values(spark, ["கோ", "007a", "007", "কো"], T.normalize("s")) == ["ko", "007a", "7", "ko"]
    assert values(spark, ["12/4 main", "12-4 x 560001", "560001 12", "a 7"], T.tag_numbers("s")) == ["[NUM] 12/4 [/NUM] main", "[NUM] 12-4 [/NUM] x [ZIP] 560001 [/ZIP]", "[ZIP] 560001 [/ZIP] 12", "a [NUM] 7 [/NUM]"]
    assert values(spark, ["a zenith", "the zenith", "zenith"], T.is_nonce("s")) == [True, False, True]
    got = values(spark, ["flat rose 12 hill road, poona, mh", "rose lane, x"], T.parse_address("s"))
    assert [tuple(r) for r in got] == [("12", "hill", "pune", "maharashtra"), ("", "rose", "rose lane", "x")]
    assert values(spark, [" Bombay", "Ünknown", None, "..."], T.alias_lookup("s")) == ["mumbai", "unknown", "", "..."]


def test_batches_of_pairs_are_as_one_by_one():
    """Windows, reaches and beginnings of all pairs at once give the very numbers of the plain loops."""
    import random

    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abcdeéß𝔸 ") for _ in range(rnd.choice([0, 1, 2, 3, n])))
    pairs = [(word(n), word(m)) for n in (5, 30, 63, 64, 65) for m in (4, 33, 64, 70, 300) for _ in range(12)]
    pairs += [("a\0b\0", "b\0"), ("\0", "a"), ("", ""), ("x" * 64, "x" * 64), ("ab" * 32, "ba" * 40), ("martha", "marhta")]
    a, b = ([p[k] for p in pairs] for k in (0, 1))
    sort = lambda t: " ".join(sorted(t.split()))
    for many, one in ((S.ratios, S.ratio_of), (S.partial_ratios, S.partial_ratio_of), (S.jaro_winklers, S.jaro_winkler_of),
                      (S.token_sort_ratios, lambda x, y: S.ratio_of(sort(x), sort(y)))):
        assert list(many(a, b)) == [one(x, y) for x, y in zip(a, b)], one
    assert list(S.ratios([], [])) == []
