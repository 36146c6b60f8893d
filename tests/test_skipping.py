"""Searches that open no file they need not, and streams that end by themselves."""

import os
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from broadsheet.operators.search import search
from broadsheet.plans.runs import search_run
from broadsheet.schemas import CORPUS
from broadsheet.sources.corpus import read_corpus, stream_corpus, stream_files
from broadsheet.sources.skipping import _bitmaps, corpus_files, files_to_read, read_matching_corpus, trigram_bits, update_text_index
from broadsheet.streaming.search import CappedSearch, read_capped, read_progress, stream_search, stream_search_capped

TERMS = ["gold", "GOLD rush", "ö-ß", "new york", "xyz", "of", "", "a_b%", "rush\ngold"]


def article(number, day, text):
    names = [f.strip().split()[0] for f in CORPUS.split(",")] if isinstance(CORPUS, str) else CORPUS.fieldNames()
    known = {"article_id": str(number), "full_article_id": number, "date": day, "article": text}
    return tuple(known.get(n) for n in names)


def put(spark, folder, name, rows):
    """One Parquet file of a given name."""
    scratch = Path(tempfile.mkdtemp(dir=Path(folder).parent)) / "write"
    spark.createDataFrame(rows, CORPUS).coalesce(1).write.parquet(str(scratch))
    Path(folder).mkdir(parents=True, exist_ok=True)
    target = Path(folder) / name
    target.write_bytes(next(scratch.glob("part-*.parquet")).read_bytes())
    return target


def spoil(path):
    """Keep size and time of a file, but make it unreadable."""
    state = path.stat()
    path.write_bytes(b"x" * state.st_size)
    os.utime(path, ns=(state.st_atime_ns, state.st_mtime_ns))


@pytest.fixture
def corpus(spark, tmp_path):
    folder = tmp_path / "a corpus+%41"
    texts = {
        "a_1900.parquet": ["The Gold Rush of 1900", "nothing"], "b_1900.parquet": ["Ö-ß and New  York", None, "of"], "c_1901.parquet": ["gold\nrush, a_b%c", "new york"],
        "d_1901.parquet": [None, "", "ab"], "e_1902.parquet": ["rush\ngold ö-ß", "gol d"],
    }
    for at, (name, rows) in enumerate(texts.items()):
        put(spark, folder, name, [article(at * 10 + i, f"{name[2:6]}-03-0{i + 1}", t) for i, t in enumerate(rows)])
    return str(folder)


def found(rows, term, start="1900-01-01", end="1902-12-31"):
    return sorted(r.article_id for r in search(rows, term, start, end).collect())


def test_trigrams(spark):
    rows = spark.createDataFrame([("abcd",), ("ABCDABC",), ("ab",), ("",), (None,), ("😀é\n",)], "t string")
    bits = [r.b for r in rows.select(trigram_bits(F.col("t")).alias("b")).collect()]
    assert [len(b) for b in bits] == [2, 4, 0, 0, 0, 1] and set(bits[0]) <= set(bits[1])
    assert all(0 < x <= 1 << 20 for b in bits for x in b)


def test_runs_are_marked_in_arrays(spark, corpus, tmp_path):
    """A task gives a file's bitmap, and not a row per run of an article."""
    assert "Generate" not in _bitmaps(read_corpus(spark, corpus))._jdf.queryExecution().executedPlan().toString()
    folder, index, piece = tmp_path / "long", str(tmp_path / "index"), 1 << 20
    texts = ["a" * (piece - 2) + "zebra", "a" * piece + "okapi"]
    for at, text in enumerate(texts):
        put(spark, folder, f"{at}_1900.parquet", [article(at, "1900-01-01", text)])
    update_text_index(spark, str(folder), index)
    for at, term in enumerate(("azebra", "aokapi")):
        assert [Path(p).name for p in files_to_read(spark, str(folder), index, term)] == [f"{at}_1900.parquet"]


@pytest.mark.parametrize("term", TERMS)
def test_same_matches_as_the_scan(spark, corpus, tmp_path, term):
    index = str(tmp_path / "index")
    assert found(read_matching_corpus(spark, corpus, index, term), term) == found(read_corpus(spark, corpus), term)
    assert update_text_index(spark, corpus, index) == 5 and update_text_index(spark, corpus, index) == 0
    assert found(read_matching_corpus(spark, corpus, index, term), term) == found(read_corpus(spark, corpus), term)


def test_other_files_are_not_opened(spark, corpus, tmp_path):
    index = str(tmp_path / "index")
    update_text_index(spark, corpus, index)
    names = lambda term, *years: [p[-14:] for p in files_to_read(spark, corpus, index, term, *years)]
    assert names("gold rush") == ["a_1900.parquet"] and names("xyzzy") == []
    assert names("gold") == ["a_1900.parquet", "c_1901.parquet", "e_1902.parquet"] and names("gold", 1902, 1901) == ["c_1901.parquet", "e_1902.parquet"]
    assert len(names("of")) == 5 and names("of", 1900, 1900) == ["a_1900.parquet", "b_1900.parquet"]
    for name in ("b_1900", "c_1901", "d_1901", "e_1902"):
        spoil(Path(corpus) / f"{name}.parquet")
    assert found(read_matching_corpus(spark, corpus, index, "gold rush"), "gold rush") == ["0"]
    run = search_run(spark, corpus, str(tmp_path / "out"), "gold rush", "1900-01-01", "1902-12-31", index=index)
    assert spark.read.json(f"{run}/articles").count() == 1
    assert found(read_matching_corpus(spark, corpus, index, "xyzzy"), "xyzzy") == []


def test_new_and_changed_files_are_read(spark, corpus, tmp_path):
    index = str(tmp_path / "index")
    update_text_index(spark, corpus, index)
    put(spark, corpus, "f_1902.parquet", [article(90, "1902-01-01", "late zebra")])
    put(spark, Path(corpus), "b_1900.parquet", [article(91, "1900-01-01", "changed zebra")])
    assert found(read_matching_corpus(spark, corpus, index, "zebra"), "zebra") == ["90", "91"]
    assert update_text_index(spark, corpus, index) == 2
    assert len(files_to_read(spark, corpus, index, "zebra")) == 2 and len(files_to_read(spark, corpus, index, "ö-ß")) == 1


def test_year_folders(spark, tmp_path):
    corpus, index = str(tmp_path / "by-year"), str(tmp_path / "index")
    rows = [article(i, f"190{i}-01-01", f"year number {i} {'pear' if i % 2 else 'plum'}") for i in range(6)]
    frame = spark.createDataFrame(rows, CORPUS).withColumn("year", F.substring("date", 1, 4).cast("int"))
    frame.write.partitionBy("year").parquet(corpus)
    assert sorted(r.year for r in corpus_files(spark, corpus).select("year").distinct().collect()) == list(range(1900, 1906))
    update_text_index(spark, corpus, index)
    assert len(files_to_read(spark, corpus, index, "pear")) == 3
    read = read_matching_corpus(spark, corpus, index, "pear", 1901, 1903)
    assert found(read, "pear", "1901-01-01", "1905-12-31") == ["1", "3"]


def test_streams_open_files_of_searched_years_only(spark, corpus, tmp_path):
    spoil(Path(corpus) / "a_1900.parquet")
    spoil(Path(corpus) / "b_1900.parquet")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream_search(spark, corpus, out, state, "gold", "1901-01-01", "1902-12-31", files_per_batch=2).awaitTermination()
    assert sorted(r.article_id for r in spark.read.parquet(out).collect()) == ["20", "40"]
    assert stream_corpus(spark, corpus).isStreaming and stream_files(spark, corpus).columns == ["path", "year"]


def test_progress_of_more_batches_than_spark_keeps(spark, corpus, tmp_path):
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    try:
        out, state, steps = (str(tmp_path / n) for n in ("out", "state", "steps"))
        query = stream_search(spark, corpus, out, state, "gold", "1900-01-01", "1902-12-31", files_per_batch=1, progress=steps)
        query.progress_table.finish(query)
        assert len(query.recentProgress) <= 2
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    rows = read_progress(spark, steps)
    assert rows.select("batch").distinct().count() == 5 and rows.count() == 15
    totals = {r.year: (r.read, r.matched) for r in rows.groupBy("year").agg(F.sum("read").alias("read"), F.sum("matched").alias("matched")).collect()}
    assert totals == {1900: (5, 1), 1901: (5, 1), 1902: (2, 1)}


def aged(path, seconds):
    os.utime(path, (1_700_000_000 + seconds,) * 2)


def test_capped_stream_ends_when_years_are_full(spark, tmp_path):
    folder = tmp_path / "in"
    for at, year in enumerate((1900, 1900, 1901, 1901, 1902)):
        path = put(spark, folder, f"{at}_{year}.parquet", [article(at * 10 + i, f"{year}-01-01", "word") for i in range(3)])
        aged(path, at)
    args = (str(tmp_path / "out"), str(tmp_path / "state"), "word", "1900-01-01", "1901-12-31", 2)
    # the second file of a full year, the year that is not searched, and what comes when all is full
    for name in ("1_1900", "3_1901", "4_1902"):
        spoil(folder / f"{name}.parquet")
    query = stream_search_capped(spark, str(folder), *args, files_per_batch=1, once=False)
    query.awaitTermination(60)
    assert not query.isActive and query.exception() is None
    kept = {r.year: r["count"] for r in read_capped(spark, args[0]).groupBy("year").count().collect()}
    assert kept == {1900: 2, 1901: 2}
    # started again with more files it opens none
    aged(put(spark, folder, "5_1900.parquet", [article(99, "1900-01-01", "word")]), 9)
    spoil(folder / "5_1900.parquet")
    again = stream_search_capped(spark, str(folder), *args, files_per_batch=1)
    again.awaitTermination(60)
    assert read_capped(spark, args[0]).count() == 4


def test_a_batch_that_is_run_again_ends_the_same(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    first = put(spark, folder, "0_1900.parquet", [article(i, "1900-01-01", "word") for i in range(3)])
    second = put(spark, folder, "1_1900.parquet", [article(10 + i, "1900-01-02", "word") for i in range(3)])
    batch = lambda path: spark.createDataFrame([(f"file:{path}", 1900)], "path string, year int")
    writer = CappedSearch(str(folder), out, 5, "word", "1900-01-01", "1900-12-31")
    writer(batch(first), 0)
    for _ in range(2):
        writer(batch(second), 1)
        assert sorted(r.article_id for r in read_capped(spark, out).collect()) == ["0", "1", "10", "11", "2"]
        counts = spark.read.parquet(writer.counts_path(1)).first()
        assert (counts.year, counts.read, counts.matched, counts.taken) == (1900, 3, 3, 5) and writer.full_at == 1
