"""X16 parse_dataset and X11 extract_features as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..functions.counts import text_counts
from ..schemas import require_columns


def parse_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
                compat: bool = False) -> DataFrame:
    """Title, body_text and word_count for every page; every row is kept.

    One scan, one projection.  Pages whose markup hints at a content
    container send their html to the X2 helper; every other row sends a null,
    so only those pages cross into Python (the Arrow batch of the rest is
    empty).  Pages where the helper finds no real container fall back to the
    native X3 extraction.
    """
    require_columns(pages, html_col, *keep)
    html = F.col(html_col)
    dom_input = F.when(H.has_container_hint(html), html)
    body = F.coalesce(H.dom_body(dom_input, compat), H.fallback_body(html, compat))
    out = pages.select(
        *keep,
        H.extract_title(html).alias("title"),
        body.alias("body_text"),
    )
    return out.withColumn("word_count", X.word_count("body_text"))


def extract_features(df: DataFrame, text_col: str = "body_text",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """X11 over a table: word_count, sentence_count, flesch_reading_ease.

    One pass over each text in Arrow batches (``counts.text_counts``), by the rules of ``text.text_features``.
    """
    require_columns(df, text_col, *keep)
    counted = df.select(*keep, text_counts(text_col).alias("_n"))
    wc, sc, syl = (F.col(f"_n.{x}") for x in ("words", "sentences", "syllables"))
    return counted.select(
        *keep,
        wc.alias("word_count"),
        sc.alias("sentence_count"),
        X.flesch_reading_ease(wc, sc, syl).alias("flesch_reading_ease"),
    )


def documents_as_content(docs: DataFrame) -> DataFrame:
    """S2 over the documents table: (doc_id, url, body_text) with the null rule."""
    require_columns(docs, "doc_id", "text")
    return docs.select(
        "doc_id",
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"),
        X.text_or_empty("text").alias("body_text"),
    )
