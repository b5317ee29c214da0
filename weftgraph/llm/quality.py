"""Quality rules whose cutoffs carry a guarantee, by DataFrame functions alone.

Every rule rejects documents beyond a cutoff of one measure. Cutoffs come from a fixed
grid, strictest first. Labelled documents of good quality are the holdout: within a
stratum (a language), a cutoff is certified if the exact binomial probability of seeing
at most its number of rejected good documents, were the true rate of false rejection
ALPHA / number of rules, is at most DELTA divided by the number of tests (strata x rules
x cutoffs, Bonferroni). The strictest certified cutoff of each rule applies; where none is
certified, the rule rejects nothing in that stratum. So with probability 1 - DELTA no
stratum loses more than ALPHA of its good documents to the rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import storage
from weftgraph.llm import names

SPACE = r"[\x20\x09-\x0D]"
#: Share of a stratum's good documents that all rules together may reject.
ALPHA = 0.05
#: Probability with which that may fail, over all strata.
DELTA = 0.05
MIN_WORDS = 50
#: Rule -> cutoffs on its measure, strictest first; a document beyond the cutoff is rejected.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.05, 0.1, 0.2, 0.4, 0.8),
    "dup_line_ratio": (0.1, 0.2, 0.3, 0.5),
    "repeat_word_ratio": (0.1, 0.2, 0.3, 0.4),
    "mean_word_chars": (7.0, 8.0, 10.0, 12.0, 16.0),
    "neg_mean_word_chars": (-4.0, -3.0, -2.0),
    "shout_ratio": (0.1, 0.2, 0.3, 0.5),
}
STRATUM = "lang"
#: Terms of a binomial tail that are summed one by one.
TERMS = 2048


def features(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, stratum, the columns in keep, and the base measures (long).

    n_words, word_chars, n_symbols, n_shouts (capitals A-Z and exclamation marks), n_lines
    (with a word), n_dup_lines, n_repeat_words. A null text has no words. Three-word
    windows are compared by 64-bit hash.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    stratum = F.coalesce(F.col(STRATUM).cast("string"), F.lit("")) if STRATUM in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, stratum.alias("stratum"), text.alias("t_"))
    lines = F.filter(F.split("t_", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = rows.select(
        "doc_id", *keep, "stratum",
        F.array_remove(F.split("t_", SPACE + "+", -1), "").alias("words_"),
        lines.alias("lines_"),
        (F.char_length("t_") - F.regexp_count("t_", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("t_", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t_", F.lit("[A-Z!]")).cast("long").alias("n_shouts"),
    )
    kept = ("doc_id", *keep, "stratum", "word_chars", "n_symbols", "n_shouts")
    w = F.col("words_")
    counted = split.select(
        *kept,
        F.size("words_").cast("long").alias("n_words"),
        F.size("lines_").cast("long").alias("n_lines"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words_") >= 3, F.transform(F.sequence(F.lit(0), F.size("words_") - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))).alias("windows_"),
    )
    kept += ("n_words", "n_lines", "n_dup_lines")
    ordered = counted.select(*kept, F.sort_array("windows_").alias("s_"))
    s = F.col("s_")
    twice = F.filter("s_", lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < F.size(s) - 1) & (s[F.least(i + 1, F.size(s) - 1)]["h"] == x["h"])))
    starts = ordered.select(*kept, twice.alias("twice_")).select(*kept, F.sort_array(F.transform("twice_", lambda x: x["i"])).alias("at_"))
    covered = F.aggregate(
        "at_",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return starts.select(*kept, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    """Whether a document fails for what it is: under 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """Each rule's measure of a document with words."""
    words = F.col("n_words").cast("double")
    mean = F.col("word_chars") / words
    return {
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.col("n_lines").cast("double"),
        "repeat_word_ratio": F.col("n_repeat_words") / words,
        "mean_word_chars": mean,
        "neg_mean_word_chars": -mean,
        "shout_ratio": F.col("n_shouts") / F.col("word_chars").cast("double"),
    }


def _log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function at x >= 1, by Stirling's series from x + 16 on."""
    y = x + F.lit(16.0)
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    for j in range(16):
        series = series - F.log(x + F.lit(float(j)))
    return series


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Bin(n, rate), 0 <= k <= n, in bounded memory for any n.

    Below the mean, terms are summed from k down, else from k + 1 up and taken from one; they
    fall from the first on. TERMS of them are summed, and what is left out is bounded by a geometric
    series, so the value is exact to rounding up to some millions of n, and beyond that
    errs upwards alone.
    """
    up, down = F.lit(rate / (1 - rate)), F.lit((1 - rate) / rate)
    low = k < n * F.lit(rate)
    first = F.when(low, k).otherwise(k + 1).cast("double")
    log_first = _log_gamma(n + 1.0) - _log_gamma(first + 1.0) - _log_gamma(n - first + 1.0) + first * F.lit(math.log(rate)) + (n - first) * F.lit(math.log1p(-rate))
    count = F.least(F.when(low, k).otherwise(n - k - 1), F.lit(TERMS).cast("long"))  # terms after the first

    def ratio(j: Column) -> Column:
        """Term j + 1 over term j, counted from the first."""
        return F.when(low, (first - j) / (n - first + j + 1) * down).otherwise((n - first - j) / (first + j + 1) * up)

    def step(acc, j):
        term = acc["term"] * ratio(j)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(count >= 1, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), step)
    rest = F.when(low & (count < k), total["term"] * ratio(count) / (1 - ratio(count))).otherwise(0.0)
    lower = F.exp(log_first) * (total["sum"] + rest)
    return F.when(low, F.least(lower, F.lit(1.0))).when(k >= n, F.lit(1.0)).otherwise(F.greatest(1 - F.exp(log_first) * total["sum"], F.lit(0.0)))


def cutoffs(table: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Certified cutoffs: stratum and, for each rule, its cutoff (double; null where none is certified).

    labels: doc_id, quality (1 good); a document labelled more than once counts as good if
    any label says so. Documents that fail the base are no part of the holdout.
    """
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("q_")).where("q_ = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    held = table.where(~base_failed()).join(good, "doc_id", "left_semi")
    of = measures()
    counts = [F.count_if(of[r] > c).alias(f"k_{r}_{i}") for r, cs in RULES.items() for i, c in enumerate(cs)]
    per = held.groupBy("stratum").agg(F.count("*").alias("n"), *counts)
    tests = table.select("stratum").distinct().count() * sum(len(cs) for cs in RULES.values())
    rate = alpha / len(RULES)

    # a row for each test of a stratum
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(float(c)).alias("cut"), F.col(f"k_{r}_{i}").alias("k")) for r, cs in RULES.items() for i, c in enumerate(cs)]))
    tested = per.select("stratum", "n", each.alias("t")).select("stratum", "n", "t.*")
    certified = tested.where(binomial_tail(F.col("k"), F.col("n"), rate) <= F.lit(delta / max(1, tests)))
    return certified.groupBy("stratum").agg(*[F.min_by(F.when(F.col("rule") == r, F.col("cut")), F.when(F.col("rule") == r, F.col("i"))).alias(f"cut_{r}") for r in RULES])


def judged(table: DataFrame, labels: DataFrame) -> DataFrame:
    """The features with base_failed and kept (boolean).

    Ratios of documents without words are null and break no rule; such documents fail the
    base. Repeated rows are each judged. An empty table gives an empty result.
    """
    cuts = storage.materialize(cutoffs(table, labels), "cutoffs")
    cuts = storage.maybe_broadcast(cuts)
    of = measures()
    beyond = F.lit(False)
    for r in RULES:
        beyond = beyond | F.coalesce(of[r] > F.col(f"cut_{r}"), F.lit(False))
    joined = table.join(cuts, "stratum", "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | beyond)).drop(*[f"cut_{r}" for r in RULES])


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict."""
    docs = storage.table(spark, sf_dir, "documents")
    table = storage.materialize(features(docs), "quality")
    out = judged(table, storage.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept, with all their columns.

    Verdicts join by doc_id and text hash, so rows that share an id are told apart, rows
    without an id are judged too, and rows that repeat stay as they are.
    """
    key, own, d, h = F.xxhash64("text"), *(names.free(x, docs.columns) for x in ("key_", "d_", "h_"))
    table = storage.materialize(features(docs.withColumn(own, key), (own,)), "quality")
    rejected = judged(table, storage.table(spark, sf_dir, "labels")).where("NOT kept").select(F.col("doc_id").alias(d), F.col(own).alias(h)).distinct()
    rejected = storage.maybe_broadcast(storage.materialize(rejected, "rejected"))
    return docs.join(rejected, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (key == F.col(h)), "left_anti")


def _oracle() -> str:
    def case(rule: str, cs: tuple[float, ...]) -> str:
        tail = "list_sum(list_transform(range(0, k_{0}_{1} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({2}) + (n - i) * ln(1 - {2}))))"
        return f"CASE {' '.join(f'WHEN {tail.format(rule, i, ALPHA / len(RULES))} <= {DELTA} / ({sum(map(len, RULES.values()))} * (SELECT count(DISTINCT stratum) FROM m)) THEN {c}' for i, c in enumerate(cs))} END AS cut_{rule}"

    counts = ", ".join(f"count(*) FILTER (WHERE {r} > {c}) AS k_{r}_{i}" for r, cs in RULES.items() for i, c in enumerate(cs))
    return rf"""
WITH d AS (SELECT doc_id, coalesce({STRATUM}, '') AS stratum, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM d),
w AS (SELECT doc_id, unnest(ws) AS a, unnest(range(1, len(ws) + 1)) AS p FROM s),
g AS (SELECT doc_id, p, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT p + j) AS n_repeat_words FROM h, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY doc_id),
f AS (SELECT s.doc_id, stratum, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '[A-Z!]'))::BIGINT AS n_shouts,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM s LEFT JOIN r ON r.doc_id = s.doc_id),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_symbols / nullif(n_words, 0)::DOUBLE AS symbol_ratio, n_dup_lines / nullif(n_lines, 0)::DOUBLE AS dup_line_ratio,
  n_repeat_words / nullif(n_words, 0)::DOUBLE AS repeat_word_ratio, word_chars / nullif(n_words, 0)::DOUBLE AS mean_word_chars,
  -(word_chars / nullif(n_words, 0)::DOUBLE) AS neg_mean_word_chars, n_shouts / nullif(word_chars, 0)::DOUBLE AS shout_ratio FROM f),
k AS (SELECT stratum, count(*) AS n, {counts} FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY stratum),
c AS (SELECT stratum, {", ".join(case(r, cs) for r, cs in RULES.items())} FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR {" OR ".join(f"coalesce({r} > cut_{r}, false)" for r in RULES)}) AS kept
FROM m LEFT JOIN c USING (stratum)"""


ORACLE = _oracle()
