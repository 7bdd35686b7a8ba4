"""Lexicon sentiment (valence-aware scoring after Hutto & Gilbert 2014).

Per token: lexicon valence; a booster among the 3 previous tokens adds
±0.293 (decayed 1 / 0.95 / 0.9 with distance) in the direction of the
valence; each negation among the 3 previous tokens multiplies by -0.74.
Per text: compound = s / sqrt(s^2 + 15); pos / neg / neu are the shares of
(v + 1), |v - 1| and neutral tokens.  Texts of 10 characters or fewer score 0.

Spark plan: tokens are exploded with their position; only tokens found in
the (broadcast, size-checked) resource tables survive, so every later join
and aggregation works on the small hit table, keyed by (doc, position).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.labels import sentiment_label
from ..functions.resources import (BOOSTER_INCREMENT, BOOSTERS, NEGATION_SCALAR, NEGATION_WINDOW,
                                   NEGATIONS, SENTIMENT_ALPHA, SEED_LEXICON)

# --- FIXED VALUES: token pattern and distance decay -------------------------
SENT_TOKEN = r"[\p{L}\p{N}_']+"
DECAY = {1: 1.0, 2: 0.95, 3: 0.9}
MIN_CHARS = 10


def resource_table(spark: SparkSession, lexicon: DataFrame | None = None) -> DataFrame:
    """One row per resource word: (term, valence | null, is_neg, dir)."""
    lex = lexicon if lexicon is not None else spark.createDataFrame(SEED_LEXICON, "term string, valence double")
    parts = [
        lex.select("term", F.col("valence").cast("double"), F.lit(False).alias("is_neg"), F.lit(0).alias("dir")),
        spark.createDataFrame([(w,) for w in NEGATIONS], "term string").select(
            "term", F.lit(None).cast("double").alias("valence"), F.lit(True).alias("is_neg"), F.lit(0).alias("dir")),
        spark.createDataFrame(BOOSTERS, "term string, dir int").select(
            "term", F.lit(None).cast("double").alias("valence"), F.lit(False).alias("is_neg"), "dir"),
    ]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("term").agg(F.max("valence").alias("valence"), F.max("is_neg").alias("is_neg"),
                                 F.sum("dir").alias("dir"))


def sentiment_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     lexicon: DataFrame | None = None) -> DataFrame:
    """(id, neg, neu, pos, compound, sentiment) for every input row."""
    spark = docs.sparkSession
    res = resource_table(spark, lexicon)
    if lexicon is None:  # the built-in lists; a user's lexicon is joined as its size allows
        res = F.broadcast(res)
    t = X.text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("doc"), F.length(t).alias("_len"),
                       F.regexp_extract_all(F.lower(t), F.lit(SENT_TOKEN), 0).alias("_tok"))
    base = base.withColumn("ntok", F.when(F.col("_len") > MIN_CHARS, F.size("_tok")).otherwise(0))
    toks = base.filter(F.col("_len") > MIN_CHARS).select("doc", F.posexplode("_tok").alias("pos", "term"))
    hits = toks.join(res, "term")          # only resource words survive: a small table
    # the 3 previous positions of each hit, within its document
    w = Window.partitionBy("doc").orderBy("pos").rangeBetween(-NEGATION_WINDOW, -1)
    ctx = F.collect_list(F.struct("pos", "is_neg", "dir")).over(w)
    h = hits.select("doc", "pos", "valence", ctx.alias("ctx")).filter(F.col("valence").isNotNull())
    k = F.size(F.filter("ctx", lambda c: c["is_neg"]))
    dist = lambda c: F.col("pos") - c["pos"]
    decay = lambda c: F.when(dist(c) == 1, DECAY[1]).when(dist(c) == 2, DECAY[2]).otherwise(DECAY[3])
    b = F.aggregate("ctx", F.lit(0.0), lambda acc, c: acc + c["dir"] * F.lit(BOOSTER_INCREMENT) * decay(c))
    v = F.col("valence")
    scored = h.select("doc", ((v + F.signum(v) * b) * F.pow(F.lit(NEGATION_SCALAR), k)).alias("s"))
    per_doc = scored.groupBy("doc").agg(
        F.sum("s").alias("sum_s"),
        F.sum(F.when(F.col("s") > 0, F.col("s") + 1)).alias("pos_sum"),
        F.sum(F.when(F.col("s") < 0, F.col("s") - 1)).alias("neg_sum"),
        F.count(F.when(F.col("s") != 0, 1)).alias("n_scored"))
    j = base.select("doc", "ntok").join(per_doc, "doc", "left")
    sum_s = F.coalesce(F.col("sum_s"), F.lit(0.0))
    pos_sum = F.coalesce(F.col("pos_sum"), F.lit(0.0))
    neg_sum = F.coalesce(F.col("neg_sum"), F.lit(0.0))
    neu = (F.col("ntok") - F.coalesce(F.col("n_scored"), F.lit(0))).cast("double")
    total = pos_sum + F.abs(neg_sum) + neu
    share = lambda x: F.when(total > 0, F.round(F.abs(x / total), 3)).otherwise(0.0)
    compound = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), sum_s / F.sqrt(sum_s * sum_s + SENTIMENT_ALPHA)))
    out = j.select(F.col("doc").alias(id_col), share(neg_sum).alias("neg"), share(neu).alias("neu"),
                   share(pos_sum).alias("pos"), F.round(compound, 4).alias("compound"))
    return out.withColumn("sentiment", sentiment_label("compound"))


def sentiment_distribution(scores: DataFrame) -> DataFrame:
    """Documents per sentiment label."""
    return scores.groupBy("sentiment").agg(F.count(F.lit(1)).cast("long").alias("n"))


def sentiment_means(scores: DataFrame) -> DataFrame:
    """Mean pos / neu / neg."""
    return scores.agg(F.avg("pos").alias("pos"), F.avg("neu").alias("neu"), F.avg("neg").alias("neg"))
