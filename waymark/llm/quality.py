"""Quality classifier: hashed word n-grams, FTRL logistic regression, sparse dot products.

Tokens are runs of word characters or of other non-space characters, so that shouting,
cell bars and sign noise are tokens as well. Unigrams and bigrams are hashed into `DIM` features with value
log(1 + count), scaled to length 1. The model is fitted on at most `max_rows` labelled
rows (those with the smallest hash of the id), so what reaches the driver is bounded;
the weights (`DIM` x 4 bytes) are broadcast and every whole text is scored in Arrow maps.

Edge cases: a null or empty text has no features and gets the score of the bias; null
labels and null ids are not learned from; repeated labels of a document count once,
the largest, and of the texts of an id that repeats the least; repeated documents are
scored each; without any label every score is 0.5.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from waymark.llm._common import WordHashes, arrow_columns, as_bytes, fold, mix, prepare, table
from waymark.llm.linear import ftrl, sigmoid

DIM = 1 << 20
MAX_ROWS = 8_000
TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]+")
_hashes = WordHashes()


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Unique feature numbers and their values."""
    words = TOKEN.findall(text) if text else []
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    h = _hashes.of(words)
    grams = np.concatenate([h, mix(h[:-1]) + h[1:] * np.uint64(3)]) if len(h) > 1 else h
    idx, count = np.unique((mix(grams) >> np.uint64(44)).astype(np.int64), return_counts=True)
    x = np.log1p(count)
    return idx, x / np.sqrt(x @ x)


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, max_rows: int, text: str = "text") -> DataFrame:
    """At most `max_rows` rows (text, y). The sample of ids is broadcast: it has that bound."""
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train)
        .groupBy("doc_id")
        .agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id")
        .limit(max_rows)
    )
    found = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def learn(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias of rows (text, y), a bounded sample."""
    prepare(rows.sparkSession)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t) for t in as_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i.astype("<i4").tobytes() for i, _ in made], pa.binary()),
                    pa.array([x.astype("<f4").tobytes() for _, x in made], pa.binary()),
                    batch.column("y").cast(pa.int32()),
                ],
                names=["i", "x", "y"],
            )

    got = rows.mapInArrow(featurise, "i binary, x binary, y int").toArrow()
    data = [
        (np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float), y)
        for i, x, y in sorted(zip(*(got.column(c).to_pylist() for c in "ixy")), key=lambda r: (r[0], r[2]))
    ]
    return ftrl(data, DIM)


def classify(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (its columns `keep`) with the score of each whole text."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        w, b = sent.value
        out = []
        for t in as_bytes(batch, text):
            idx, x = features(t)
            out.append(float(w[idx] @ x) + b)
        return [pa.array(sigmoid(np.array(out, float)), pa.float64())]

    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    return arrow_columns(docs, compute, [StructField("score", DoubleType())], keep)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(True))


def op9_quality(spark: SparkSession, sf_dir: str, max_rows: int = MAX_ROWS) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(labelled(docs, table(spark, sf_dir, "labels"), "quality", ~held_out(), max_rows))
    scored = classify(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
