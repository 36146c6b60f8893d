"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.arrays import Texts, slices
from broadsheet.llm.folds import held_out, own_sample
from broadsheet.runtime import stage

#: Bytes per gram, and hashed dimensions of a vector.
GRAMS = (2, 3)
DIMENSIONS = 4096
CENTROIDS = 4
#: Learning rows per language.
SAMPLE = 1500
#: A text nearer to its centroid than all but this share of the centroid's own learning rows is accepted.
REJECTED_SHARE = 0.005
UNKNOWN = "und"
_ROWS = 256

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def gram_counts(texts: Texts) -> np.ndarray:
    """Counts of hashed byte grams, one row per text; anything in ASCII but letters counts as a blank."""
    data = _LETTER[texts.data].astype(np.uint32)
    n = len(texts.at) - 1
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(texts.at)) * DIMENSIONS
    out = np.zeros(n * DIMENSIONS, np.int64)
    for size in GRAMS:
        m = len(data) - size + 1
        if m <= 0:
            continue
        gram = np.full(m, size, np.uint32)
        for k in range(size):
            gram = (gram << np.uint32(8)) | data[k : k + m]
        gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(20)
        inside = owner[:m] == owner[size - 1 :]
        out += np.bincount(owner[:m][inside] + gram[inside], minlength=len(out))
    return out.reshape(n, DIMENSIONS)


def vectors(texts: Texts, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length one (zero for a text without grams)."""
    weighted = np.log1p(gram_counts(texts)).astype(np.float32) * idf
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)


def clustered(rows: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts: centroids, and the cosine that few of their rows fall below."""
    centroids = [rows.mean(0)]
    while len(centroids) < min(k, len(rows)):
        nearest = np.max(rows @ np.stack(centroids).T, axis=1)
        centroids.append(rows[int(np.argmin(nearest))])
    centers = np.stack(centroids)
    for _ in range(rounds):
        centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
        own = np.argmax(rows @ centers.T, axis=1)
        centers = np.stack([rows[own == j].sum(0) if (own == j).any() else centers[j] for j in range(len(centers))])
    centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    best = rows @ centers.T
    own = np.argmax(best, axis=1)
    floors = [np.quantile(best[own == j, j], REJECTED_SHARE) if (own == j).any() else 1.0 for j in range(len(centers))]
    return centers.astype(np.float32), np.array(floors, np.float32)


class Centroids(NamedTuple):
    languages: list[str]  # of each centroid
    matrix: np.ndarray  # one row per centroid
    floors: np.ndarray  # least cosine that is no rejection
    idf: np.ndarray


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> Centroids | None:
    """Learn from about SAMPLE rows per language that are not held out; None if there are none.

    Document frequencies are added up over the sample in Spark; each language is clustered in its own
    task. The result is CENTROIDS rows of DIMENSIONS numbers per language.
    """
    sample = own_sample(docs, lang, SAMPLE, text=text).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sample = stage(sample, "languages")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found = 0, np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for part in slices(pc.utf8_lower(batch.column(0)), rows=_ROWS):
                rows += len(part.at) - 1
                found += (gram_counts(part) > 0).sum(0)
        columns = [pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate(([rows], found)))]
        yield pa.RecordBatch.from_arrays(columns, ["gram", "n"])

    partial = sample.select("text").mapInArrow(frequencies, "gram long, n long")
    counts = {r.gram: r.n for r in partial.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    total = counts.get(-1, 0)
    if not total:
        return None
    idf = np.log((1 + total) / (1 + np.array([counts[i] for i in range(DIMENSIONS)]))).astype(np.float32) + 1

    def cluster(table: pa.Table) -> pa.Table:
        rows = [vectors(part, idf) for part in slices(pc.utf8_lower(table["text"]), rows=_ROWS)]
        centers, floors = clustered(np.concatenate(rows), CENTROIDS)
        values = pa.array([c.tolist() for c in centers], pa.list_(pa.float32()))
        names = pa.array([table["lang"][0].as_py()] * len(centers))
        return pa.table({"lang": names, "center": values, "least": pa.array(floors)})

    found = sample.groupBy("lang").applyInArrow(cluster, "lang string, center array<float>, least float").collect()
    found = sorted(found, key=lambda r: (r.lang, r.center))
    matrix = np.array([r.center for r in found], np.float32)
    return Centroids([r.lang for r in found], matrix, np.array([r.least for r in found], np.float32), idf)


def identify(docs: DataFrame, model: Centroids | None, *, text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine to the nearest centroid) and rejected, for every row.

    ``rejected`` marks texts farther from their nearest centroid than nearly all its learning rows; they
    keep its language. A null text, one without any letter, or every text if nothing was learned, is
    ``und`` with score 0, and rejected. Equal cosines go to the first language by name. Null ids and
    repeated rows get their rows; an empty table gives none; other columns are not read.
    """
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    rows = docs.select("doc_id", held_out().alias("held_out"), lettered, F.col(text).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = batch.column(2).to_numpy(zero_copy_only=False)
            for part in slices(pc.utf8_lower(batch.column(3)), rows=_ROWS):
                known = flags[part.rows] & (model is not None)
                names, score, low = np.full(len(known), UNKNOWN, object), np.zeros(len(known)), np.ones(len(known), bool)
                if known.any():
                    cosines = vectors(part, model.idf) @ model.matrix.T
                    best = np.argmax(cosines, axis=1)
                    top = np.clip(cosines[np.arange(len(best)), best], 0, 1)
                    names[known] = np.array(model.languages, object)[best[known]]
                    score[known] = top[known]
                    low[known] = top[known] < model.floors[best[known]]
                columns = [batch.column(0)[part.rows], batch.column(1)[part.rows]]
                columns += [pa.array(names, pa.string()), pa.array(score), pa.array(low)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean"
    return rows.mapInArrow(predict, schema)
