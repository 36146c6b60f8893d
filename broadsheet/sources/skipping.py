"""An index beside a corpus that tells which of its files can hold a search term."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.runtime import local_table
from broadsheet.sources.corpus import read_corpus, year_of_path

#: Bits of a file's bitmap, in parts of 32,768 bits, the size that Spark's bitmap functions have.
BITS = 1 << 20

_FILE = ["path", "size", "changed"]
_INDEX = "path string, size long, changed timestamp, bitmap binary, bucket int"


def _marker() -> Callable[[str, np.ndarray], None]:
    """Array code that marks the numbers of a text's runs; a closure, so that workers need no package for it."""
    shift, pieces = np.uint64(65 - BITS.bit_length()), 1 << 20
    factors = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def mark(text: str, marks: np.ndarray) -> None:
        for at in range(0, len(text) - 2, pieces):
            points = np.frombuffer(text[at : at + pieces + 2].encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
            # a code point has 21 bits; products wrap around
            runs = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
            runs *= factors[0]
            runs ^= runs >> np.uint64(32)
            runs *= factors[1]
            marks[(runs >> shift).astype(np.int64)] = True

    return mark


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def trigram_bits(text: Column) -> Column:
    """Different numbers 1 to BITS of all runs of three characters, in lower case; none for shorter and null texts.

    Two runs may share a number, so a set bit means that a text may hold a run, and a bit that is not set means
    that it does not.
    """
    mark, bits = _marker(), BITS

    def numbers(lower: str) -> list[int]:
        marks = np.zeros(bits, bool)
        mark(lower, marks)
        return (np.flatnonzero(marks) + 1).tolist()

    return F.udf(numbers, "array<long>")(_lower(text))


def corpus_files(spark: SparkSession, corpus: str) -> DataFrame:
    """Path, size, time of change and year of each Parquet file, from the listing alone."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(corpus)
        .select(
            F.regexp_replace("path", "^file:/+", "file:/").alias("path"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("changed"),
        )
    )
    return found.withColumn("year", year_of_path("path"))


def update_text_index(spark: SparkSession, corpus: str, index: str) -> int:
    """Add the files of ``corpus`` that ``index`` does not know in their present state; how many there were.

    A file has a bitmap of the three-character runs of all its articles. A task marks the runs of its part of a
    file in one bitmap, so what is moved is at most 128 kB per file and task. Entries are only added; those of
    changed and removed files no longer fit any file and are not used.
    """
    listed = corpus_files(spark, corpus)
    known = _entries(spark, index)
    if known is not None:
        listed = listed.join(known.where("bucket = 0").select(*_FILE).distinct(), _FILE, "left_anti")
    paths = [row.path for row in listed.select("path").collect()]
    if paths:
        _bitmaps(read_corpus(spark, corpus, files=paths)).write.mode("append").partitionBy("bucket").parquet(index)
    return len(paths)


def _bitmaps(articles: DataFrame) -> DataFrame:
    mark, bits, per_bucket = _marker(), BITS, 1 << 15

    def entry(file: tuple[str, int, int], marks: np.ndarray) -> pa.RecordBatch:
        maps = np.packbits(marks.reshape(-1, per_bucket), axis=1, bitorder="little")
        held = np.flatnonzero(maps.any(axis=1))
        # bit 0, in a bucket of its own, marks a file as known
        rows = [b"\x01".ljust(per_bucket // 8, b"\0"), *(maps[i].tobytes() for i in held)]
        same = [pa.array([value] * len(rows)) for value in file]
        return pa.RecordBatch.from_arrays([*same, pa.array([0, *(held + 1)], pa.int32()), pa.array(rows)], names)

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, marks = None, np.zeros(bits, bool)
        for batch in batches:
            for *of, text in zip(*(column.to_pylist() for column in batch.columns)):
                if of != file:
                    if file:
                        yield entry(file, marks)
                    file = of
                    marks[:] = False
                mark(text, marks)
        if file:
            yield entry(file, marks)

    names = ["path", "size", "changed", "bucket", "bitmap"]
    found = articles.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.unix_micros("_metadata.file_modification_time").alias("changed"),
        _lower(F.col("article")).alias("text"),
    )
    found = found.mapInArrow(bitmaps, "path string, size long, changed long, bucket int, bitmap binary")
    found = found.groupBy(*_FILE, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    # the path is a URI here, and a plain path in a listing
    path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    found = found.select(path.alias("path"), "size", F.timestamp_micros("changed").alias("changed"), "bitmap", "bucket")
    return found.hint("rebalance", "bucket")


def _entries(spark: SparkSession, index: str) -> DataFrame | None:
    """The index, or None if it was not begun."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(index)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(_INDEX).parquet(index)


def files_to_read(
    spark: SparkSession,
    corpus: str,
    index: str,
    term: str,
    start_year: int | None = None,
    end_year: int | None = None,
) -> list[str]:
    """Files that can hold ``term``, of the years asked for; only their paths come to the driver.

    Left out are files whose entry lacks one of the term's runs. A file that is new or has changed since the
    index was last updated is read, and so is every file if the term has fewer than three characters.
    """
    files = corpus_files(spark, corpus)
    if start_year is not None and end_year is not None:
        lo, hi = sorted((int(start_year), int(end_year)))
        files = files.where(F.col("year").between(lo, hi) | F.col("year").isNull())
    entries = _entries(spark, index)
    # bounded by the length of the term
    bits = spark.range(1).select(F.explode(trigram_bits(F.lit(term))).alias("bit"))
    bits = bits.select(F.bitmap_bucket_number("bit").cast("int"), F.bitmap_bit_position("bit"))
    wanted = [tuple(row) for row in bits.collect()]
    if entries is not None and wanted:
        needed = local_table(spark, wanted, bucket=pa.int32(), position=pa.int64())
        entries = entries.where(F.col("bucket").isin(0, *{bucket for bucket, _ in wanted}))
        byte = F.conv(F.hex(F.substring("bitmap", (F.col("position") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.getbit(byte, (F.col("position") % 8).cast("int")) == 1
        # each update has whole files, and a file that was listed twice has the same bitmap twice
        found = entries.join(needed, "bucket", "left").groupBy(*_FILE)
        found = found.agg(F.count_distinct(F.when(is_set, F.struct("bucket", "position"))).alias("n"))
        files = files.join(found.where(F.col("n") < len(wanted)), _FILE, "left_anti")
    return [row.path for row in files.select("path").orderBy("path").collect()]


def read_matching_corpus(
    spark: SparkSession,
    corpus: str,
    index: str,
    term: str,
    start_year: int | None = None,
    end_year: int | None = None,
) -> DataFrame:
    """``read_corpus`` over the files that can hold ``term``; the others are not opened."""
    files = files_to_read(spark, corpus, index, term, start_year, end_year)
    return read_corpus(spark, corpus, start_year, end_year, files=files)
