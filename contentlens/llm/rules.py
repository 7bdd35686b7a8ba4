"""Quality rules with risk-controlled thresholds; DataFrame operations only.

Base rules reject texts of too few or mostly repeated words.  The other rules reject a text when a
measure (share of symbols, of capitals, of exclamation and question marks, of repeated lines) reaches a cutoff.  Cutoffs are
not set by hand: for every stratum (band of text length) and rule, labelled documents give for each cutoff
of a fixed grid the number of good documents it rejects.  A cutoff is certified if the exact binomial
(Clopper-Pearson) upper bound of its false rejection rate is at most RISK / rules, so that all rules of a
stratum together reject at most RISK of its good documents.  Cutoffs are tested from the loosest to
the tightest and testing stops at the first failure (fixed-sequence testing, no correction needed within a
grid); the error level is divided by the number of strata and rules (Bonferroni).  Among
certified cutoffs the one that rejects most bad documents, each wrongly rejected good one
counting as ``GOOD_COST`` bad ones, is used; if none gains anything the rule is off in that stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, free_name

MIN_WORDS = 50
REPEAT_PERCENT = 50
STRATA = (150, 600)          # word counts at which a longer band begins
RISK = 0.04                        # most good documents of a stratum that all rules together may reject
ERROR = 0.05                       # chance that any certificate of the whole table is wrong
GOOD_COST = 20
GRID = 100                         # cutoffs per measure: k / GRID of its range
RULES = ("symbols", "capitals", "marks", "dup_lines")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _placed_windows(words: Column) -> Column:
    """Sorted (hash, place) of the three-word windows; equal neighbours are windows that occur again.

    Everything after this sort is linear: equal neighbours mark both places, and the words that
    marked windows cover are counted from the gaps between marked places."""
    n = F.size(words)
    windows = F.zip_with(
        F.zip_with(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), F.slice(words, 2, F.greatest(n - 2, F.lit(0))),
                   lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.slice(words, 3, F.greatest(n - 2, F.lit(0))), lambda ab, c: F.xxhash64(ab["a"], ab["b"], c))
    return F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _covered(placed: Column) -> Column:
    """Sorted places of the windows that occur twice or more, from the sorted (hash, place) pairs."""
    m = F.size(placed)
    twins = F.zip_with(F.slice(placed, 1, F.greatest(m - 1, F.lit(0))), F.slice(placed, 2, F.greatest(m - 1, F.lit(0))),
                       lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    return F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))


def _union_length(places: Column) -> Column:
    m = F.size(places)
    gaps = F.zip_with(F.slice(places, 1, F.greatest(m - 1, F.lit(0))), F.slice(places, 2, F.greatest(m - 1, F.lit(0))),
                      lambda a, b: F.least(b - a, F.lit(3)))
    return F.when(m == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda s, x: s + x)).cast("long")


def _steps(text_col: str, names: dict[str, str]):
    """Projections that add the measures under the given free names, each array built once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    c = {k: F.col(v) for k, v in names.items()}
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        {"words": _words(text), "lines": lines},
        {"n_words": F.size(c["words"]).cast("long"), "placed": _placed_windows(c["words"]),
         "n_dup_lines": (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long"),
         "word_chars": (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"),
         "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
         "n_capitals": F.regexp_count(text, F.lit(r"[A-Z]")).cast("long"),
         "n_marks": F.regexp_count(text, F.lit(r"[!?]")).cast("long"),
         "n_lines": F.size(c["lines"]).cast("long")},
        {"places": _covered(c["placed"])},
        {"n_repeat_words": _union_length(c["places"])},
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_lines")


def with_measures(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` plus the measures as columns of free names (returned as measure -> column)."""
    names: dict[str, str] = {}
    for k in (*MEASURES, "words", "lines", "placed", "places"):
        names[k] = free_name(docs, f"_m_{k}")
    out = docs
    for step in _steps(text_col, names):
        out = out.withColumns({names[k]: v for k, v in step.items()})
    return out.drop(*(names[k] for k in ("words", "lines", "placed", "places"))), names


def base_failed(m: dict[str, Column]) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])


def stratum(n_words: Column) -> Column:
    out = F.lit(0)
    for bound in STRATA:
        out = out + F.when(n_words >= bound, 1).otherwise(0)
    return out


def rule_values(m: dict[str, Column]) -> dict[str, Column]:
    """Each rule's measure on 0..1, higher is worse."""
    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.least(a / b, F.lit(1.0))).otherwise(0.0)
    return {"symbols": share(m["n_symbols"], m["word_chars"]), "capitals": share(m["n_capitals"], m["word_chars"]),
            "marks": share(m["n_marks"], m["word_chars"]), "dup_lines": share(m["n_dup_lines"], m["n_lines"])}


def _bin(value: Column) -> Column:
    """Largest k with value >= k / GRID: a document is rejected by every cutoff up to its bin."""
    return F.floor(value * GRID).cast("int")


def log_binomial(n: Column, k: Column) -> Column:
    """ln C(n, k) by Stirling's series of ln gamma, shifted by eight so that it is exact to 1e-12."""
    def lgamma(x: Column) -> Column:
        y = x + 8
        low = F.lit(0.0)
        for j in range(8):
            low = low + F.log(x + j)
        return ((y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y)
                + 1 / (1260 * F.pow(y, F.lit(5))) - low)
    return lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p): the largest term by logarithms, the others by their ratios going down.

    Below the mean the terms fall at least as fast as a bell curve, so 12 standard deviations of terms hold the
    sum to double precision; callers use it for k below the mean only."""
    top = F.exp(log_binomial(n.cast("double"), k.cast("double")) + k * math.log(p) + (n - k) * math.log1p(-p))
    many = F.least(k, F.ceil(12 * F.sqrt(n * p * (1 - p)) + 40)).cast("int")
    odds = (1 - p) / p
    ratios = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(ratios, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda s, j: F.struct(
        (s["term"] * (k - j) / (n - k + j + 1) * odds).alias("term"),
        (s["sum"] + s["term"] * (k - j) / (n - k + j + 1) * odds).alias("sum")))
    return top * total["sum"]


def certified(false_rejected: Column, good: Column, risk: float, error: float) -> Column:
    """Whether the exact upper bound of the false rejection rate is at most ``risk`` at level ``error``."""
    below_mean = false_rejected < good * risk
    return F.when(below_mean, binomial_tail(good, false_rejected, risk) <= error).otherwise(F.lit(False))


def select_cutoffs(judged: DataFrame, risk: float = RISK, error: float = ERROR, good_cost: float = GOOD_COST) -> DataFrame:
    """(stratum, rule, cutoff_bin, good, false_rejected, bad_rejected) of the rules in use.

    ``judged``: rows (stratum, good boolean, one value column per rule), base failures left out."""
    per_rule, level = risk / len(RULES), error / (len(RULES) * (len(STRATA) + 1))
    long = judged.select("stratum", "good", F.explode(F.array(*(
        F.struct(F.lit(r).alias("rule"), _bin(F.col(r)).alias("bin")) for r in RULES))).alias("x"))
    counts = (long.groupBy("stratum", "x.rule", "x.bin")
              .agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b")))
    # at most strata * rules * (GRID + 1) rows from here on
    part = Window.partitionBy("stratum", "rule")
    down = part.orderBy(F.col("bin").desc())
    grid = (counts.select("stratum", "rule").distinct()
            .withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(GRID))))
            .join(counts, ["stratum", "rule", "bin"], "full_outer").fillna(0, ["g", "b"]))
    tested = (grid.withColumn("false_rejected", F.sum("g").over(down)).withColumn("bad_rejected", F.sum("b").over(down))
              .withColumn("good", F.sum("g").over(part))
              .filter("bin > 0")
              .withColumn("ok", certified(F.col("false_rejected"), F.col("good"), per_rule, level).cast("int"))
              .withColumn("ok", F.min("ok").over(down))
              .withColumn("gain", F.col("bad_rejected") - good_cost * F.col("false_rejected"))
              .filter("ok = 1 AND gain > 0"))
    best = Window.partitionBy("stratum", "rule").orderBy(F.col("gain").desc(), F.col("bin").desc())
    return (tested.withColumn("place", F.row_number().over(best)).filter("place = 1")
            .select("stratum", "rule", F.col("bin").alias("cutoff_bin"), "good", "false_rejected", "bad_rejected"))


def fit_cutoffs(measured: DataFrame, names: dict[str, str], labels: DataFrame, id_col: str = "doc_id",
                target: str = "quality") -> dict[tuple[int, str], int]:
    """Cutoff bins by (stratum, rule), certified on all labelled documents.

    The rules are fixed beforehand and only cutoffs are chosen, so every labelled document is a holdout.  Of conflicting labels of one id the smaller holds; null ids and labels other than 0 and 1 take no
    part.  The driver receives at most strata * rules rows."""
    known = (labels.select(F.col(id_col).alias("_id"), F.col(target).cast("int").alias("_y"))
             .filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
             .groupBy("_id").agg(F.min("_y").alias("_y")))
    m = {k: F.col(v) for k, v in names.items()}
    slim = measured.filter(~base_failed(m)).select(
        F.col(id_col).alias("_id"), stratum(m["n_words"]).alias("stratum"), *(v.alias(r) for r, v in rule_values(m).items()))
    judged = slim.join(known, "_id").withColumn("good", F.col("_y") == 1)
    return {(r["stratum"], r["rule"]): r["cutoff_bin"] for r in select_cutoffs(judged).collect()}


def kept(m: dict[str, Column], cutoffs: dict[tuple[int, str], int]) -> Column:
    """Whether a document passes the base rules and every cutoff of its stratum."""
    band, values, rejected = stratum(m["n_words"]), rule_values(m), base_failed(m)
    for (s, rule), k in sorted(cutoffs.items()):
        rejected = rejected | ((band == s) & (_bin(values[rule]) >= k))
    return ~rejected


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail the base rules; repeated rows are judged alike; other columns are
    not read; without labels (or with too few to certify a cutoff) only the base rules reject; an
    empty table gives an empty result."""
    measured, names = with_measures(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    held = cut(measured.drop("text"), "measures")
    m = {k: F.col(v) for k, v in names.items() if k in MEASURES}
    cutoffs = fit_cutoffs(held, {k: names[k] for k in MEASURES}, labels.withColumnRenamed(id_col, "doc_id"))
    return held.select("doc_id", *(m[k].alias(k) for k in MEASURES[:5]), base_failed(m).alias("base_failed"), kept(m, cutoffs).alias("kept"))


def keep_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, columns unchanged."""
    measured, names = with_measures(docs, text_col)
    held = cut(measured, "measured")
    names = {k: names[k] for k in MEASURES}
    cutoffs = fit_cutoffs(held, names, labels, id_col)
    m = {k: F.col(v) for k, v in names.items()}
    return held.filter(kept(m, cutoffs)).drop(*names.values())


def _oracle() -> str:
    """DuckDB twin over ``documents`` and ``labels``: plain counts, and the binomial sum by its definition."""
    values = {"symbols": "n_symbols, word_chars", "capitals": "n_capitals, word_chars", "marks": "n_marks, word_chars",
              "dup_lines": "n_dup_lines, n_lines"}
    bins = ", ".join(
        "floor((CASE WHEN {1} > 0 THEN least({0}::DOUBLE / {1}, 1.0) ELSE 0.0 END) * {2})::INTEGER AS {3}".format(
            *v.split(", "), GRID, k) for k, v in values.items())
    long = " UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, {r} AS bin, y FROM judged" for r in RULES)
    band = " + ".join(f"(n_words >= {b})::INTEGER" for b in STRATA)
    risk, error = RISK / len(RULES), ERROR / (len(RULES) * (len(STRATA) + 1))
    rejected = " OR ".join(f"(rule = '{r}' AND {r} >= cutoff)" for r in RULES)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM win JOIN (SELECT rid, x FROM win GROUP BY rid, x HAVING count(*) > 1) USING (rid, x)),
covered AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals,
             len(regexp_extract_all(text, '[!?]')) AS n_marks, len(lines) AS n_lines FROM w LEFT JOIN covered USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed, {band} AS stratum, {bins} FROM m),
judged AS (SELECT f.*, y FROM f JOIN (SELECT doc_id, min(quality) AS y FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id)
           USING (doc_id) WHERE NOT base_failed),
tested AS (
  SELECT stratum, rule, k, count(*) FILTER (WHERE y = 1) AS good, count(*) FILTER (WHERE y = 1 AND bin >= k) AS fr,
         count(*) FILTER (WHERE y = 0 AND bin >= k) AS br
  FROM ({long}), range(1, {GRID + 1}) AS g(k) GROUP BY ALL),
proved AS (
  SELECT *, bool_and(fr < good * {risk} AND list_sum(list_transform(range(0, fr + 1), lambda i: exp(lgamma(good + 1) - lgamma(i + 1)
              - lgamma(good - i + 1) + i * ln({risk}) + (good - i) * ln(1 - {risk})))) <= {error})
            OVER (PARTITION BY stratum, rule ORDER BY k DESC) AS ok, br - {GOOD_COST} * fr AS gain FROM tested),
cuts AS (SELECT stratum, rule, arg_max(k, gain * {GRID + 1} + k) AS cutoff FROM proved WHERE ok AND gain > 0 GROUP BY ALL),
out AS (SELECT DISTINCT rid FROM f JOIN cuts USING (stratum) WHERE {rejected})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM out) AS kept FROM f"""


ORACLE = _oracle()
