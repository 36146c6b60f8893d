"""The operators of this subpackage as queries over whole tables, with their production parameters."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from functools import partial
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import (
    byte_network,
    collocations,
    decontamination,
    hard_negatives,
    language,
    packing,
    quality_rules,
    secret_scan,
    sharding,
    simhash,
    sql,
    token_counts,
    token_files,
    toxicity,
)
from broadsheet.runtime import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        source = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="broadsheet-")) / "broadsheet.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted((source / "broadsheet").rglob("*.py")):
                out.write(file, file.relative_to(source))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text is trusted: those labelled to be of good quality."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.score_quality(docs, trusted(spark, sf_dir), keep=["doc_id"])


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards, then reads every record back and gives its place and checksum."""
    path = scratch_path(spark, "tokens")
    layout = token_files.write_token_shards(table(spark, sf_dir, "documents"), BYTE_BPE, path)
    return token_files.read_token_shards(spark, path, layout)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_network.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are every fiftieth vector; every seventh has a wrong label."""
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", wrong)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ship(spark)
    return byte_network.of_good_quality(docs, table(spark, sf_dir, "labels"))


def good_shape(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    return quality_rules.of_good_shape(docs, trusted(spark, sf_dir))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return simhash.without_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in packed sequences."""
    ship(spark)
    return packing.pack(docs, BYTE_BPE)


def queries() -> dict[str, Query]:
    def shipped(query: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return {name: partial(shipped, f) for name, f in globals().items() if name.startswith("op")}


def _overlap_sql() -> str:
    """op2 in SQL, without its seeds: all words are compared wherever three in a row agree, as they do in every overlap."""
    split = "list_filter(regexp_split_to_array(lower(text), '{}'), lambda w: w <> '')".format(r"[^\p{L}\p{N}]+")
    seeded = "SELECT *, h[pos + 1:pos + 3] AS key"
    same = "CASE WHEN place + i BETWEEN 0 AND len(h) - 1 AND h[place + i + 1] = p[i + 1] THEN 1 ELSE 0 END"
    return f"""WITH texts AS (SELECT doc_id, {split} AS h FROM documents),
        words AS (SELECT item_id, {split} AS h FROM benchmark),
        passages AS (SELECT h, min(item_id) AS item_id FROM words WHERE len(h) >= {decontamination.LEAST_WORDS} GROUP BY h),
        text_keys AS ({seeded} FROM (SELECT *, unnest(range(0, len(h) - 2)) AS pos FROM texts)),
        item_keys AS ({seeded} FROM (SELECT *, unnest(range(0, len(h) - 2)) AS pos FROM passages)),
        hits AS (SELECT DISTINCT doc_id, item_id, t.pos - i.pos AS place FROM text_keys t JOIN item_keys i ON t.key = i.key),
        compared AS (
            SELECT doc_id, item_id, place, len(p) AS n, least({decontamination.STRETCH}, len(p)) AS width,
                   list_transform(range(0, len(p)), lambda i: {same}) AS same
            FROM (SELECT hits.*, texts.h, passages.h AS p FROM hits JOIN texts USING (doc_id) JOIN passages USING (item_id))),
        found AS (
            SELECT *, list_sum(same) AS total FROM compared
            WHERE list_max(list_transform(range(0, n - width + 1), lambda s: list_sum(same[s + 1:s + width])))
                  >= CASE WHEN n < 7 THEN n ELSE ceil(width * {decontamination.SHARE}) END)
        SELECT doc_id, item_id, CAST(arg_max(place, total * 1000000000 - place) AS BIGINT) AS position,
               CAST(max(n) AS BIGINT) AS item_words, CAST(max(total) AS BIGINT) AS matched, max(total) / max(n) AS overlap
        FROM found GROUP BY doc_id, item_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB where it can say the same; see the tests for the other queries."""
    return {
        "op2_decontamination": _overlap_sql(),
        "op11_collocations": sql.COLLOCATIONS,
        "op13_hard_negatives": sql.HARD_NEGATIVES,
    }
