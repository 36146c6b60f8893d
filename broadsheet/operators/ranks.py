"""Top-N lists and rank series for charts."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions.ranking import rank_by_frequency
from broadsheet.runtime import local_table, scalar
from broadsheet.schemas import require_columns

BY_TIME_COLUMNS = ("time_bin", "collocate_term", "ordinal_rank")


def top_collocates(metrics: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most frequent collocates, in order."""
    require_columns(metrics, ("collocate_term", "frequency"), "the metrics table")
    return metrics.orderBy(F.desc("frequency"), "collocate_term").limit(n)


def preview(df: DataFrame, n: int = 100, order: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in ``order``, by default by all columns from the left."""
    return df.orderBy(*(order or df.columns)).limit(n)


def bins_in_order(by_time: DataFrame) -> DataFrame:
    return by_time.select("time_bin").distinct().orderBy(F.to_date("time_bin"))


def home_bin(by_time: DataFrame, number: int) -> Column:
    """Label of the ``number``-th bin (from 1), clamped to the first and last one."""
    return scalar(bins_in_order(by_time).limit(max(1, int(number))), F.max("time_bin"))


def _in_order(top: DataFrame, *by) -> DataFrame:
    """Add ``term_order``. The window sees the chosen n rows only."""
    return top.withColumn("term_order", F.row_number().over(Window.orderBy(*by)))


def home_bin_terms(by_time: DataFrame, n: int, number: int) -> DataFrame:
    """``collocate_term, term_order``: the best ``n`` terms of one bin."""
    require_columns(by_time, BY_TIME_COLUMNS, "the by-time table")
    top = (
        by_time.where(F.col("time_bin") == home_bin(by_time, number))
        .where(F.col("ordinal_rank").isNotNull())
        .orderBy("ordinal_rank", "collocate_term")
        .limit(n)
    )
    return _in_order(top, "ordinal_rank", "collocate_term").select("collocate_term", "term_order")


def mean_ranks(by_time: DataFrame) -> DataFrame:
    """Mean rank per term over the bins in which it occurs."""
    return by_time.groupBy("collocate_term").agg(F.avg("ordinal_rank").alias("mean_rank"))


def global_terms(by_time: DataFrame, n: int) -> DataFrame:
    """``collocate_term, mean_rank, term_order``: the best ``n`` terms by mean rank."""
    require_columns(by_time, BY_TIME_COLUMNS, "the by-time table")
    means = mean_ranks(by_time).where(F.col("mean_rank").isNotNull())
    return _in_order(
        means.orderBy("mean_rank", "collocate_term").limit(n), "mean_rank", "collocate_term"
    )


def rank_series(by_time: DataFrame, terms: DataFrame) -> DataFrame:
    """Ranks of the chosen terms over all bins, in long form, with their legend order.

    ``terms`` is a limited list of n rows, so Spark broadcasts it by its own size estimate.
    """
    chosen = terms.select("collocate_term", "term_order")
    return by_time.join(chosen, "collocate_term").select(
        "time_bin", "collocate_term", "frequency", "ordinal_rank", "term_order"
    )


def rank_matrix(by_time: DataFrame, terms: Sequence[str]) -> DataFrame:
    """One row per bin, one column per term with its best rank; bins without any term stay."""
    wide = (
        by_time.where(F.col("collocate_term").isin(list(terms)))
        .groupBy("time_bin")
        .pivot("collocate_term", list(terms))
        .agg(F.min("ordinal_rank"))
    )
    return (
        by_time.select("time_bin")
        .distinct()
        .join(wide, "time_bin", "left")
        .orderBy(F.to_date("time_bin"))
    )


def ranked_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics with ``rank``: 1..n by frequency, then term."""
    return rank_by_frequency(metrics, [], "frequency", "collocate_term", "rank")


def drop_candidates(metrics: DataFrame, selected: Sequence[str], top: int = 150) -> DataFrame:
    """Terms offered for dropping: the first ``top``, and every selected term, with their ranks.

    Selected terms that do not occur appear with null rank and frequency. The vocabulary is never
    ranked as a whole: the first terms are a limit, and for the selected ones the terms ahead of them
    are counted in one aggregate.
    """
    terms = metrics.where(F.col("collocate_term").isNotNull()).select("collocate_term", "frequency")
    place = F.struct((-F.col("frequency")).alias("less"), F.col("collocate_term").alias("term"))
    first = terms.orderBy(F.desc("frequency"), "collocate_term").limit(top)
    numbered = first.agg(F.array_sort(F.collect_list(place)).alias("places")).select(F.posexplode("places").alias("at", "p"))
    chosen = terms.where(F.col("collocate_term").isin(list(selected)))
    wanted = terms.withColumn("_chosen", scalar(chosen, F.collect_list(place))).select(
        place.alias("own"), F.explode(F.filter("_chosen", lambda c: c >= place)).alias("p")
    )
    counted = wanted.groupBy("p").agg((F.count("*") - 1).cast("int").alias("at"))  # a term is not ahead of itself
    ranked = numbered.select("p", "at").union(counted.select("p", "at")).distinct()
    ranked = ranked.select(
        F.col("p.term").alias("collocate_term"),
        (-F.col("p.less")).alias("frequency"),
        (F.col("at") + 1).cast("long").alias("rank"),
    )
    picked = local_table(
        metrics.sparkSession, [(t,) for t in sorted(set(selected))], _picked=pa.string()
    )
    return ranked.join(picked, F.col("collocate_term") == F.col("_picked"), "full_outer").select(
        F.coalesce("collocate_term", "_picked").alias("collocate_term"),
        "frequency",
        "rank",
        F.col("_picked").isNotNull().alias("selected"),
    )


def search_terms(candidates: DataFrame, text: str = "", up_to_length: int = 0) -> DataFrame:
    """Candidates that hold ``text``; with a length, only terms of at most that many characters."""
    term = F.col("collocate_term")
    shown = candidates.where(F.lower(term).contains(text.strip().lower()))
    return shown.where(F.length(term) <= up_to_length) if up_to_length > 0 else shown
