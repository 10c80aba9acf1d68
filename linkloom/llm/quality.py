"""Quality rules as a learned decision list.

`measures` turns a text into counts with array functions, all in the JVM. `learn` takes labelled documents, bins
their measures at quantiles, adds up (bins, fold, label) cells in Spark, and grows and prunes conjunctions of
thresholds on these cells by sequential covering. `verdict` is the list as one ordered CASE expression.

Defined results: a null text counts as empty (all counts 0); documents without labels, an empty label table and
labels that contradict each other for a document (these are left out) are all fine; without labels of both kinds the list is empty and only
the base rules judge. Repeated rows are judged one by one. Columns of the input that are not needed are ignored,
and names of helper columns start with `_q_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import SPACE, table

#: Most labelled rows that are learned from, chosen by a hash of their id.
LEARN_ROWS = 20_000
#: Cut points for each measure, at most.
CUTS = 24
MOST_RULES = 16
MOST_CONDITIONS = 4
#: Least share of truly bad documents among those that a rule takes, in the rows it is grown on and those it is pruned on.
PRECISION = 0.95
#: Least number of documents that a rule takes.
SUPPORT = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the five counts of the contract and those that rules use, each whole-text and without a shuffle.

    Repeated three-word windows are found by sorting (window, position) within the row, so a text of n words takes
    n log n steps and no row leaves its task.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_q_t", t)
    df = df.withColumn("_q_w", F.filter(F.split("_q_t", SPACE), lambda w: w != ""))
    df = df.withColumn("_q_lines", F.filter(F.split("_q_t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_q_n", F.size("_q_w"))
    windows = "transform(sequence(1, _q_n - 2), i -> concat_ws(' ', _q_w[i - 1], _q_w[i], _q_w[i + 1]))"
    df = df.withColumn("_q_g", F.expr(f"CASE WHEN _q_n < 4 THEN array() ELSE {windows} END"))
    # most texts repeat no window: only the others are sorted
    df = df.withColumn("_q_s", F.expr("CASE WHEN size(array_distinct(_q_g)) = size(_q_g) THEN array() ELSE sort_array(transform(_q_g, (g, i) -> struct(g AS g, i AS i))) END"))
    again = "(k > 0 AND x.g = _q_s[k - 1].g) OR (k + 1 < size(_q_s) AND x.g = _q_s[k + 1].g)"
    df = df.withColumn("_q_p", F.expr(f"transform(filter(_q_s, (x, k) -> {again}), x -> x.i)"))
    chars = F.char_length("_q_t")
    without = lambda c: chars - F.char_length(F.regexp_replace("_q_t", c, ""))
    repeated = F.size(F.array_distinct(F.flatten(F.transform("_q_p", lambda p: F.array(p, p + 1, p + 2))))).cast("long")
    # always true, but not to the optimizer: else a filter on this column would move below and put the arrays' definitions into the lambdas
    fenced = F.when(F.spark_partition_id() >= 0, repeated)
    return df.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in {*COUNTS, "_q_upper", "_q_marks", "_q_kinds", "_q_rows"}],
        F.col("_q_n").cast("long").alias("n_words"),
        F.aggregate("_q_w", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        without(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        fenced.alias("n_repeat_words"),
        without(r"[A-Z]").cast("long").alias("_q_upper"),
        without(r"[.,;:!?]").cast("long").alias("_q_marks"),
        F.size(F.array_distinct("_q_w")).cast("long").alias("_q_kinds"),
        F.size("_q_lines").cast("long").alias("_q_rows"),
    )


def measures() -> dict[str, Column]:
    """The measures that rules compare with thresholds, from the columns of with_counts; none depends on the text's language."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("_q_rows"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "upper": F.col("_q_upper") / chars,
        "marks": F.col("_q_marks") / words,
        "kinds": F.col("_q_kinds") / words,
        "line_words": F.col("n_words") / F.greatest(F.col("_q_rows"), F.lit(1)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


Condition = tuple[str, str, float]


def cells(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, list[float]], list[tuple]]:
    """Cut points of each measure, and the labelled statistics: (bins, in the pruning fold, bad, documents)."""
    known = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_q_y"), F.max("quality").alias("_q_y2"))
        .where("_q_y = _q_y2")
        .drop("_q_y2")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(LEARN_ROWS)
    )
    names = measures()
    rows = with_counts(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")).where(~base_failed())
    rows = rows.select("doc_id", "_q_y", *[m.alias(k) for k, m in names.items()]).persist()
    try:
        at = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
        # quantiles of either class: bad documents may be few
        got = rows.agg(*[F.percentile_approx(F.when(F.col("_q_y") == y, F.col(k)), at, 1000).alias(f"{k}_{y}") for k in names for y in (0, 1)]).first()
        cuts = {k: sorted({v for y in (0, 1) for v in (got[f"{k}_{y}"] or [])}) for k in names}
        binned = [
            (F.lit(0) if not c else sum((F.when(F.col(k) > v, 1).otherwise(0) for v in c[1:]), F.when(F.col(k) > c[0], 1).otherwise(0))).alias(k)
            for k, c in cuts.items()
        ]
        fold = (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(3)) == 0).alias("_q_fold")
        counted = rows.select(*binned, fold, (F.col("_q_y") == 0).alias("_q_bad")).groupBy(*names, "_q_fold", "_q_bad").count()
        return cuts, [(tuple(r[k] for k in names), r["_q_fold"], r["_q_bad"], r["count"]) for r in counted.collect()]  # at most LEARN_ROWS cells
    finally:
        rows.unpersist()


def cover(cuts: dict[str, list[float]], found: list[tuple]) -> list[list[Condition]]:
    """Rules, most reliable part of the list first, by sequential covering on the cells.

    A condition is (measure index, bin, above). Growing adds the condition with the best FOIL gain; pruning drops last
    conditions as long as that doesn't lower (bad - good) / (bad + good) on the pruning fold; a rule stays if PRECISION
    and SUPPORT hold.
    """
    from math import log2

    names = list(cuts)
    left, rules = list(found), []

    def takes(rule, bins):
        return all((bins[k] > b) == above for k, b, above in rule)

    def tally(rule, rows):
        p = n = 0
        for bins, _, bad, c in rows:
            if takes(rule, bins):
                p, n = (p + c, n) if bad else (p, n + c)
        return p, n

    while len(rules) < MOST_RULES:
        grow, prune = [x for x in left if not x[1]], [x for x in left if x[1]]
        rule, rows = [], grow
        p0, n0 = tally([], rows)
        while p0 and n0 and len(rule) < MOST_CONDITIONS:
            best = (0.0, None, 0, 0)
            for k, name in enumerate(names):
                bad, good = [0] * (len(cuts[name]) + 1), [0] * (len(cuts[name]) + 1)
                for bins, _, is_bad, c in rows:
                    (bad if is_bad else good)[bins[k]] += c
                low_p = low_n = 0
                for b in range(len(cuts[name])):
                    low_p, low_n = low_p + bad[b], low_n + good[b]
                    for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                        if p:
                            gain = p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, (k, b, above), p, n)
            if best[1] is None:
                break
            rule.append(best[1])
            rows = [x for x in rows if takes([best[1]], x[0])]
            p0, n0 = best[2], best[3]

        def worth(r):
            p, n = tally(r, prune)
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        if not rule:
            break
        p, n = tally(rule, left)
        q, m = tally(rule, prune)
        if p < SUPPORT or p < PRECISION * (p + n) or q < PRECISION * (q + m):
            break
        rules.append([(names[k], ">" if above else "<=", cuts[names[k]][b]) for k, b, above in rule])
        left = [x for x in left if not takes(rule, x[0])]
    return rules


def learn(docs: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """The decision list: each rule a conjunction of (measure, '>' or '<=', threshold) that tells bad documents."""
    return cover(*cells(docs, labels))


def rule_number(rules: list[list[Condition]]) -> Column:
    """The first rule that takes a document, from 1; 0 if none does: one CASE in the list's order."""
    m = measures()
    case = None
    for i, rule in enumerate(rules):
        cond = None
        for name, op, v in rule:
            one = m[name] > F.lit(v) if op == ">" else m[name] <= F.lit(v)
            cond = one if cond is None else cond & one
        case = F.when(cond, i + 1) if case is None else case.when(cond, i + 1)
    return F.lit(0) if case is None else case.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the five counts, base_failed, rule (the list's rule that fired, 0 if none) and kept, in place of columns of these names."""
    rules = learn(docs, labels)
    df = with_counts(docs.drop("base_failed", "rule", "kept"))
    return df.withColumns({"base_failed": base_failed(), "rule": rule_number(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "labels")).select("doc_id", *COUNTS, "base_failed", "kept", "rule")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the list keeps, with their own columns, also those that are named as the list's."""
    labels = table(spark, sf_dir, "labels")
    rules = learn(docs, labels)
    own = {c: f"_q_own_{k}" for k, c in enumerate(docs.columns)}
    df = with_counts(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]), own["text"])
    kept = df.where(~base_failed() & (rule_number(rules) == 0))
    return kept.select(*[F.col(n).alias(c) for c, n in own.items()])
