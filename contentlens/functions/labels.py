"""Conditional labels and bands (P2-P7, P10, P12) as native CASE expressions.

NaN is turned into null first: a NaN comparison is false in Python, while
Spark orders NaN above every number (so ``NaN > 1500`` would be true).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# --- FIXED VALUES: rule thresholds -----------------------------------------
HIGH_WORDS = 1500
LOW_WORDS = 500
READ_LO, READ_HI = 50, 70
READ_HARD = 30
READ_SIMPLE = 90
THIN_WORDS = 500
SIM_HIGH, SIM_MODERATE = 0.80, 0.70
SENT_POS, SENT_NEG = 0.05, -0.05
LABEL_ORDER = ["Low", "Medium", "High"]


def _num(c) -> Column:
    x = _col(c).cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def quality_label(word_count, readability) -> Column:
    """High if wc>1500 and 50<=r<=70; else Low if wc<500 or r<30; else Medium."""
    wc, r = _num(word_count), _num(readability)
    return (F.when((wc > HIGH_WORDS) & r.between(READ_LO, READ_HI), "High")
            .when((wc < LOW_WORDS) | (r < READ_HARD), "Low")
            .otherwise("Medium"))


def baseline_label(word_count) -> Column:
    """>1500 High; <500 Low; else Medium."""
    wc = _num(word_count)
    return (F.when(wc > HIGH_WORDS, "High")
            .when(wc < LOW_WORDS, "Low")
            .otherwise("Medium"))


def is_thin(word_count, threshold: int = THIN_WORDS) -> Column:
    """Word count below the threshold (null/NaN counts are not thin)."""
    return F.coalesce(_num(word_count) < threshold, F.lit(False))


def readability_band(readability) -> Column:
    """P5: Optimal / Very Difficult / Too Simple / Could Be Improved, tested in that order."""
    r = _num(readability)
    return (F.when(r.between(READ_LO, READ_HI), "Optimal")
            .when(r < READ_HARD, "Very Difficult")
            .when(r > READ_SIMPLE, "Too Simple")
            .otherwise("Could Be Improved"))


def readability_flag(readability) -> Column:
    """P5 two-way form: Good inside 50..70, else Needs Work."""
    return F.when(_num(readability).between(READ_LO, READ_HI), "Good").otherwise("Needs Work")


def similarity_band(max_similarity) -> Column:
    """>0.80 High, >0.70 Moderate, else null (no warning)."""
    s = _num(max_similarity)
    return F.when(s > SIM_HIGH, "High").when(s > SIM_MODERATE, "Moderate")


def sentiment_label(compound) -> Column:
    """>0.05 Positive; <-0.05 Negative; else Neutral."""
    x = _num(compound)
    return F.when(x > SENT_POS, "Positive").when(x < SENT_NEG, "Negative").otherwise("Neutral")


def valid_url(url) -> Column:
    """P10: starts with http:// or https://."""
    u = _col(url)
    return F.coalesce(u.startswith("http://") | u.startswith("https://"), F.lit(False))


def format_percent(similarity) -> Column:
    """round(sim*100, 1) as text with a '%' sign."""
    return F.concat(F.round(_col(similarity) * 100, 1).cast("string"), F.lit("%"))
