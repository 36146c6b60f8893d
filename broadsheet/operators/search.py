"""Keyword and date search over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.dates import day_range
from broadsheet.functions.ranking import first_rows
from broadsheet.functions.text import contains_term, join_hyphen_breaks, page_image_to_pdf
from broadsheet.schemas import ARTICLE_COLUMNS
from broadsheet.sources.tables import last_titles


def is_match(term: str, start: str, end: str) -> Column:
    """Whether a row is in the inclusive date range and its text holds the term as a literal substring."""
    lo, hi = day_range(start, end)
    return F.coalesce(F.col("date").between(lo, hi) & contains_term(F.col("article"), term), F.lit(False))


def matching(corpus: DataFrame, term: str, start: str, end: str) -> DataFrame:
    """Rows in the inclusive date range whose text holds the term as a literal substring.

    Dates are compared as ISO text, so the range reaches the Parquet scan and, with a ``year``
    column, whole files are skipped.
    """
    lo, hi = day_range(start, end)
    in_range = F.col("date").between(lo, hi)
    if "year" in corpus.columns:
        in_range = F.col("year").between(int(lo[:4]), int(hi[:4])) & in_range
    return corpus.where(in_range & contains_term(F.col("article"), term))


def article_columns(df: DataFrame) -> DataFrame:
    """The result columns as text, and the year."""
    year = F.col("year") if "year" in df.columns else F.substring("date", 1, 4)
    return df.select(
        *[F.col(c).cast("string").alias(c) for c in ARTICLE_COLUMNS],
        year.cast("int").alias("year"),
    )


def cap_per_year(matches: DataFrame, cap: int | None) -> DataFrame:
    """The first ``cap`` matches of each year by date, then id; 0 or None keeps all."""
    if not cap:
        return matches
    return first_rows(matches, ["year"], ["date", "article_id"], int(cap))


def clean(
    matches: DataFrame,
    *,
    join_hyphens: bool = False,
    lowercase: bool = False,
    pdf_urls: bool = False,
) -> DataFrame:
    """Text repairs on results; matching has happened on the unrepaired text."""
    text = F.col("article")
    if join_hyphens:
        text = join_hyphen_breaks(text)
    if lowercase:
        text = F.lower(text)
    changed = {}
    if join_hyphens or lowercase:
        changed["article"] = text
    if pdf_urls:
        changed["url"] = page_image_to_pdf(F.col("url"))
    return matches.withColumns(changed) if changed else matches


def add_titles(matches: DataFrame, lookup: DataFrame) -> DataFrame:
    """``newspaper_name`` by newspaper id; one row out per row in."""
    titles = last_titles(lookup).withColumnRenamed("Title", "newspaper_name")
    return (
        matches.drop("newspaper_name")
        .join(titles, F.col("lccn") == F.col("SN"), "left")
        .drop("SN")
    )


def search(
    corpus: DataFrame,
    term: str,
    start: str,
    end: str,
    *,
    cap: int | None = None,
    titles: DataFrame | None = None,
    join_hyphens: bool = False,
    lowercase: bool = False,
    pdf_urls: bool = False,
) -> DataFrame:
    found = cap_per_year(article_columns(matching(corpus, term, start, end)), cap)
    if titles is not None:
        found = add_titles(found, titles)
    return clean(found, join_hyphens=join_hyphens, lowercase=lowercase, pdf_urls=pdf_urls)


def in_date_order(matches: DataFrame) -> DataFrame:
    """Results as a reader expects them; a range-partitioned sort, for writing only."""
    return matches.orderBy("date", "article_id")


def counts_by_year(matches: DataFrame, start: str, end: str) -> DataFrame:
    """Matches per searched year, zero years included, and the total under a null year."""
    lo, hi = day_range(start, end)
    years = matches.sparkSession.range(int(lo[:4]), int(hi[:4]) + 1).select(
        F.col("id").cast("int").alias("year")
    )
    counts = matches.groupBy(F.col("year").cast("int").alias("year")).agg(F.count("*").alias("n"))
    return (
        years.join(counts, "year", "left")
        .rollup("year")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("match_count"),
            F.count("*").alias("years_searched"),
        )
    )
