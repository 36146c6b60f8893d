"""Held-out rows and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.columns import small_side

#: Texts of more bytes are not learned from, and a class is learned from up to so many bytes in all.
LONGEST, BYTES = 1 << 20, 32 << 20
_FINE = 1 << 30


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is a multiple of 5. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, size: int, *, text: str = "text") -> DataFrame:
    """Columns ``label``, doc_id and ``text`` of up to ``size`` learning rows of each class, about all if it has fewer.

    Ids are drawn by a hash at the rate that their class needs, and each gives one text however many rows it has,
    so the sample is the same in every run and does not grow with the table. Of each class it holds ``size``
    rows and BYTES bytes at most, in order of that hash; texts beyond LONGEST bytes are left out. Only drawn ids
    are joined to texts; they are broadcast if counted to be small. Rows without id, label or text are not drawn.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", label)
    known = known.groupBy("doc_id").agg(F.max(label).alias(label))
    rate = _rates(known.groupBy(label).count(), label, size)
    texts = docs.select("doc_id", F.col(text).alias("text")).where(F.octet_length("text") <= LONGEST)
    drawn = texts.join(small_side(known.where(_draw(label, rate))), "doc_id")
    one = drawn.groupBy("doc_id", label).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    order = Window.partitionBy(label).orderBy(F.xxhash64("doc_id", label), "doc_id")
    so_far = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = one.select("*", F.row_number().over(order).alias("place"), so_far.alias("bytes"))
    return placed.where((F.col("place") <= size) & (F.col("bytes") <= BYTES)).select(label, "doc_id", F.col("text").alias(text))


def _rates(counts: DataFrame, label: str, size: int) -> Column:
    """Share of each class to draw, as a lookup; one number per class."""
    found = {row[label]: min(1.0, size / row["count"]) for row in counts.collect()}
    chosen = F.lit(0.0)
    for value, rate in found.items():
        chosen = F.when(F.col(label) == F.lit(value), rate).otherwise(chosen)
    return chosen


def _draw(label: str, rate: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", label), F.lit(_FINE)) < rate * _FINE


def own_sample(docs: DataFrame, label: str, size: int, *, text: str = "text") -> DataFrame:
    """Columns ``label`` and ``text`` of about ``size`` rows of each class where the label is a column of ``docs``, drawn by id."""
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & ~held_out())
    rate = _rates(known.groupBy(label).count(), label, size)
    return known.where(_draw(label, rate)).select(label, text)
