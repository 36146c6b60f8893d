"""Collocation: who stands near a word or phrase, how often, where and when."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from broadsheet.functions.dates import as_day, parse_date
from broadsheet.functions.text import SPACE_CHARS
from broadsheet.functions.tokens import (
    STOPWORDS,
    has_phrase,
    is_number,
    neighbours,
    phrase_tokens,
    tokens,
)
from broadsheet.runtime import local_table, scalar
from broadsheet.schemas import ensure_columns


@dataclass(frozen=True)
class Options:
    page_count: bool = False
    first_last_date: bool = False
    cooccurrence_rate: bool = False
    relative_position: bool = False
    drop_stopwords: bool = False
    window: int = 5
    stopwords: tuple[str, ...] = STOPWORDS

    @property
    def dropped(self) -> tuple[str, ...]:
        return self.stopwords if self.drop_stopwords else ()


ALL_METRICS = Options(
    page_count=True, first_last_date=True, cooccurrence_rate=True, relative_position=True
)


def _in_years(rows: DataFrame, start: str | None, end: str | None, undated: bool = False) -> Column:
    """Test of the ``year`` column, if there is one, against a date range."""
    keep = F.lit(True)
    if "year" not in rows.columns:
        return keep
    year = F.col("year")
    if start:
        keep = keep & (year >= as_day(start).year)
    if end:
        keep = keep & (year <= as_day(end).year)
    return keep | year.isNull() if undated and (start or end) else keep


def _same_text(column: Column, wanted: str) -> Column:
    return F.lower(column) == F.lower(F.lit(wanted))


def filter_articles(
    articles: DataFrame,
    *,
    start: str | None = None,
    end: str | None = None,
    city: str | None = None,
    state: str | None = None,
) -> DataFrame:
    """Dated articles with text, inside the inclusive range and the place.

    ``date`` becomes a date; rows whose date cannot be read are dropped. A column ``year``, as results
    written by year have, is taken as the year of the date: it lets whole folders be skipped, which a
    parsed date cannot.
    """
    keep = _in_years(articles, start, end)
    if start:
        keep = keep & (F.col("date") >= F.lit(as_day(start)))
    if end:
        keep = keep & (F.col("date") <= F.lit(as_day(end)))
    if city:
        keep = keep & _same_text(F.col("City"), city)
    if state:
        keep = keep & _same_text(F.col("State"), state)
    if articles.schema["date"].dataType != DateType():
        articles = articles.withColumn("date", parse_date(F.col("date")))
    return articles.where(keep).dropna(subset=["article", "date"])


def with_phrase(articles: DataFrame, term: str, options: Options = Options()) -> DataFrame:
    """Articles whose tokens contain the phrase."""
    phrase = phrase_tokens(term, options.dropped)
    return articles.where(has_phrase(F.col("article"), phrase, options.dropped))


def _article_key() -> Column:
    """Article id, else file name, else the row itself.

    Row numbers are stable where rows come straight from files, as search results do.
    """
    return F.coalesce(
        F.nullif(F.col("article_id").cast("string"), F.lit("")),
        F.nullif(F.col("filename").cast("string"), F.lit("")),
        F.concat(F.lit("row"), F.monotonically_increasing_id().cast("string")),
    )


def context_terms(
    articles: DataFrame,
    term: str,
    options: Options = Options(),
    carry: Sequence[str] = (),
    *,
    mark_articles: bool = False,
) -> DataFrame:
    """One row per neighbour of each hit: ``collocate_term``, ``rel`` if asked, carried columns.

    Text is tokenized once, in rows with a hit only; the exploded rows hold the term and the
    carried columns and neither text nor token arrays. ``mark_articles`` adds one row with a null
    term per article with a hit.
    """
    phrase = phrase_tokens(term, options.dropped)
    text = F.col("article")
    near = neighbours(
        tokens(text, options.dropped),
        phrase,
        options.window,
        with_position=options.relative_position,
    )
    if mark_articles:
        kind = "struct<term:string,rel:int>" if options.relative_position else "string"
        near = F.concat(near, F.array(F.lit(None).cast(kind)))
    found = articles.where(has_phrase(text, phrase, options.dropped))
    exploded = found.select(*carry, F.explode(near).alias("n"))
    if options.relative_position:
        exploded = exploded.select(*carry, F.col("n.term").alias("collocate_term"), "n.rel")
    else:
        exploded = exploded.withColumnRenamed("n", "collocate_term")
    return exploded.where(~F.coalesce(is_number(F.col("collocate_term")), F.lit(False)))


def _counts(articles: DataFrame, term: str, options: Options) -> DataFrame:
    """Measures per collocate and, if rates are asked for, under the null term the article marks."""
    sets = {}
    if options.page_count:
        sets["page"] = F.nullif(F.col("page").cast("string"), F.lit(""))
    if options.cooccurrence_rate:
        sets["article_key"] = _article_key()
    carry = [c.alias(name) for name, c in sets.items()]
    if options.first_last_date:
        carry.append(F.col("date"))
    kept = articles.select("article", *carry)
    rows = context_terms(
        kept,
        term,
        options,
        [c for c in kept.columns if c != "article"],
        mark_articles=options.cooccurrence_rate,
    )

    # Counts non-null terms, hence 0 for the group of article marks.
    parts = {"n": F.count("collocate_term")}
    whole = {"frequency": F.sum("n")}
    if options.page_count:
        whole["page_count"] = F.count("page")
    if options.first_last_date:
        parts |= {"lo": F.min("date"), "hi": F.max("date")}
        whole["first_date"] = F.date_format(F.min("lo"), "yyyy-MM-dd")
        whole["last_date"] = F.date_format(F.max("hi"), "yyyy-MM-dd")
    if options.cooccurrence_rate:
        parts["rows"] = F.count("*")
        whole |= {"article_count": F.count("article_key"), "_rows": F.sum("rows")}
    if options.relative_position:
        parts |= {"rel_sum": F.sum("rel"), "rel_n": F.count("rel")}
        whole["mean_relative_position"] = F.sum("rel_sum") / F.sum("rel_n")

    named = [c.alias(name) for name, c in parts.items()]
    if sets:
        keys = ["collocate_term", *sets]
        groups = [["collocate_term"], *[["collocate_term", k] for k in sets]]
        level = rows.groupingSets(groups, *keys).agg(F.grouping_id().alias("_set"), *named)
        # Every measure but the distinct counts comes from the (term) groups alone.
        alone = F.col("_set") == 2 ** len(sets) - 1
        level = level.withColumns({p: F.when(alone, F.col(p)) for p in parts})
    else:
        level = rows.groupBy("collocate_term").agg(*named)
    return level.groupBy("collocate_term").agg(*[c.alias(name) for name, c in whole.items()])


def collocate_metrics(
    articles: DataFrame, term: str, options: Options = Options()
) -> DataFrame:
    """Frequency and the chosen metrics per collocate.

    Distinct pages and articles are counted through grouping sets: one pass forms the groups
    (term), (term, page) and (term, article), merged before the shuffle and spread by the whole
    group, so a term that holds a third of the rows is no hot key. A second, small step counts the
    groups per term.

    The rate divides by the number of articles with a hit. Those are counted in the same pass, as
    the group of the null term. The total is read from the shuffled counts by a scalar subquery
    that Spark runs on the same shuffle, so the text is not read a second time.
    """
    wide = ensure_columns(articles, ("article_id", "filename", "page"))
    counted = _counts(wide, term, options)
    if not options.cooccurrence_rate:
        return counted
    # Spark shares the shuffle of equal plans. The subquery's plan is built anew, as a second use
    # of one plan gets new column ids inside the grouping sets and is no longer equal.
    marks = F.max(F.when(F.col("frequency") == 0, F.col("_rows")))
    total = scalar(_counts(wide, term, options), marks, keep=counted.columns)
    shown = [c for c in counted.columns if c not in ("_rows", "mean_relative_position")]
    # Naming _rows keeps it in this side's aggregate too.
    return counted.where((F.col("frequency") > 0) & (F.col("_rows") > 0)).select(
        *shown,
        (F.col("article_count") / F.greatest(F.lit(1), total)).alias("cooccurrence_rate"),
        *[c for c in ("mean_relative_position",) if options.relative_position],
    )


def by_frequency(metrics: DataFrame) -> DataFrame:
    """Metrics in reading order; a range-partitioned sort, for writing only."""
    return metrics.orderBy(F.desc("frequency"), "collocate_term")


def drop_collocates(table: DataFrame, terms: Sequence[str] | DataFrame) -> DataFrame:
    """Remove listed collocates after counting and ranking; remaining ranks keep their gaps.

    ``terms`` is a list or a DataFrame with a column ``collocate_term``; either way it is an
    anti-join, which keeps a null term, and Spark sees its size.
    """
    if not isinstance(terms, DataFrame):
        listed = sorted({str(t).strip(SPACE_CHARS) for t in terms} - {""})
        if not listed:
            return table
        terms = local_table(
            table.sparkSession, [(t,) for t in listed], collocate_term=pa.string()
        )
    return table.join(terms.select("collocate_term"), "collocate_term", "left_anti").select(table.columns)


def occurrences(
    located: DataFrame,
    term: str,
    *,
    start: str | None = None,
    end: str | None = None,
    city: str | None = None,
    state: str | None = None,
    properties: str | None = None,
) -> DataFrame:
    """Located rows that contain the phrase, stopwords counting as words; undated rows stay.

    ``properties`` names a map column to look in, so that raw features pass through untouched.
    """

    def field(name: str) -> Column:
        return F.col(properties)[name] if properties else F.col(name)

    keep = has_phrase(field("article"), phrase_tokens(term))
    if not properties:
        keep = _in_years(located, start, end, undated=True) & keep
    day = parse_date(field("date"))
    if start:
        keep = keep & F.coalesce(day >= F.lit(as_day(start)), F.lit(True))
    if end:
        keep = keep & F.coalesce(day <= F.lit(as_day(end)), F.lit(True))
    if city:
        keep = keep & _same_text(field("City"), city)
    if state:
        keep = keep & _same_text(field("State"), state)
    return located.where(keep)
