"""Search-result pages: cards out of HTML, and the URLs a text mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oppflow.functions.text import canonical_job_url, decode_entities, drop_first, found, harvested_urls

# --- fixed values: patterns of a result card -----------------------------------
JOB_ID = r"urn:li:jobPosting:(\d+)"
TITLE = [r'base-search-card__title"[^>]*>\s*([\s\S]*?)\s*</h3>',
         r'sr-only"[^>]*>\s*([\s\S]*?)\s*</span>']
COMPANY = [r'hidden-nested-link"[^>]*>\s*([\s\S]*?)\s*</a>',
           r'base-search-card__subtitle"[^>]*>\s*(?:<a[^>]*>)?\s*([\s\S]*?)\s*(?:</a>)?\s*</h4>']
LOCATION = [r'job-search-card__location"[^>]*>\s*([\s\S]*?)\s*</span>']
POSTED = r'datetime="(\d{4}-\d{2}-\d{2})"'


def _first_text(chunk: Column, patterns: list[str]) -> Column:
    """The first pattern that matches decides, even if its text is empty."""
    options = [
        F.when(chunk.rlike(p), decode_entities(F.regexp_extract(chunk, p, 1))) for p in patterns
    ]
    return F.coalesce(*options, F.lit(""))


def parse_search_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per result card; a card needs an id, a title and a company."""
    keep = [c for c in pages.columns if c != html]
    chunks = pages.select(
        *keep, F.posexplode(drop_first(F.split(html, r"<li[\s>]"), 1)).alias("card", "chunk")
    )
    c = F.col("chunk")
    cards = chunks.withColumn("job_id", found(c, JOB_ID)).filter("job_id IS NOT NULL").select(
        *keep, F.col("card").cast("bigint").alias("card"), "job_id",
        _first_text(c, TITLE).alias("title"), _first_text(c, COMPANY).alias("company"),
        _first_text(c, LOCATION).alias("location"),
        F.try_to_date(found(c, POSTED)).alias("posted"),
    )
    return cards.filter("title <> '' AND company <> ''").withColumn(
        "url", canonical_job_url("job_id")
    )


def harvest_urls(texts: DataFrame, text: str) -> DataFrame:
    """Every URL in a text, one row each, with its place in the text."""
    keep = [c for c in texts.columns if c != text]
    return texts.select(*keep, F.posexplode(harvested_urls(text)).alias("ordinal", "url")).withColumn(
        "ordinal", F.col("ordinal").cast("bigint")
    )


# --- fixed value: "Title @ Company" and its variants ---------------------------
SEARCH_TITLE = r"^(.+?)(?:\s*[@|—–-]\s*|\s+at\s+)(.+?)$"


def split_search_title(title) -> Column:
    """``(title, company)`` out of a search-result headline."""
    c = F.col(title) if isinstance(title, str) else title
    return F.struct(
        found(c, SEARCH_TITLE, 1).alias("title"), found(c, SEARCH_TITLE, 2).alias("company")
    )
