"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every labelled text of the training folds, per
language and hash bucket, inside Arrow maps; only a languages x buckets matrix
reaches the driver. Its log-probabilities are broadcast (their size is languages x
`BUCKETS` x 4 bytes, whatever the corpus) and texts are scored in batches: a gather
of the matrix at each n-gram and differences of prefix sums at text bounds. The
log-probabilities are integers (1/`SCALE` nat), so sums are exact and a score does
not depend on how rows are batched.

Edge cases: a text that is null, empty or without any letter gets `und` with score
0.0; a null doc_id counts as held out; rows with null lang or text are not learned
from; repeated rows are scored (and learned from) each; with nothing to learn from,
every text gets `und`. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from waymark.llm._common import arrow_columns, fold, prepare, slices, table

BUCKETS = 1 << 16
GRAMS = (2, 3)
SCALE = 4096.0
#: Characters that are scored at once.
CHUNK = 1 << 18
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether a character is of a letter category; digits such as ² and Ⅷ are not."""
    return any(map(str.isalpha, text))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after the other, and the bounds of each."""
    lowered = [t.lower() for t in texts]
    ends = np.cumsum([len(t) for t in lowered])
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], ends]).astype(np.int64)


def _buckets(codes: np.ndarray, n: int) -> np.ndarray:
    """The hash bucket of the n-gram that starts at each code point."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    h = np.full(size, n, np.uint32)
    for k in range(n):
        h = (h ^ codes[k : k + size]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(16)).astype(np.int64)


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", alpha: float = 0.5) -> dict:
    """The model of all rows of `docs`: languages, priors and the log-probability matrix."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist()):
                by.setdefault(k, []).append(t)
            for k, texts in by.items():
                own = seen.setdefault(k, np.zeros((len(GRAMS), BUCKETS), np.int64))
                rows[k] = rows.get(k, 0) + len(texts)
                for a, b in slices([len(t) for t in texts], CHUNK):
                    codes, bounds = _codes(texts[a:b])
                    for g, n in enumerate(GRAMS):
                        idx = _buckets(codes, n)
                        inside = np.ones(len(idx), bool)
                        for k2 in range(1, n):  # n-grams over two texts do not count
                            cut = bounds[1:-1] - k2
                            inside[cut[(cut >= 0) & (cut < len(idx))]] = False
                        own[g] += np.bincount(idx[inside], minlength=BUCKETS)
        for k, own in seen.items():
            flat = own.reshape(-1)
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(flat[at], rows[k]))],
                names=["k", "at", "n"],
            )

    counted = (
        docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
        .select(F.col(lang).alias("k"), F.col(text).alias("t"))
        .mapInArrow(count, "k string, at long, n long")
        .groupBy("k", "at")
        .agg(F.sum("n").alias("n"))
    )
    got = counted.toArrow()
    names = got.column("k").to_numpy(zero_copy_only=False).astype(object)
    at, n = got.column("at").to_numpy(), got.column("n").to_numpy()
    langs = sorted(set(names))
    matrix = np.zeros((len(langs), len(GRAMS), BUCKETS))
    docs_of = np.zeros(len(langs))
    for i, k in enumerate(langs):
        own = names == k
        grams = own & (at >= 0)
        matrix[i].reshape(-1)[at[grams]] = n[grams]
        docs_of[i] = n[own & (at < 0)].sum()
    total = matrix.sum(axis=2, keepdims=True)
    logs = np.log((matrix + alpha) / (total + alpha * BUCKETS)) if langs else matrix
    prior = np.log((docs_of + 1) / (docs_of.sum() + len(langs))) if langs else docs_of
    return {"langs": langs, "prior": prior, "logs": np.rint(logs * SCALE).astype(np.int32)}


def score(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    """The language and the posterior probability of each text."""
    langs, prior, logs = model["langs"], model["prior"], model["logs"]
    out_lang, out_score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if t and has_letter(t)] if langs else []
    for a, b in slices([len(texts[i]) for i in rows], CHUNK):
        own = rows[a:b]
        codes, bounds = _codes([texts[i] for i in own])
        sums = np.zeros((len(own), len(langs)), np.int64)
        for g, n in enumerate(GRAMS):
            idx = _buckets(codes, n)
            start = np.minimum(bounds[:-1], len(idx))
            end = np.maximum(np.minimum(bounds[1:] - n + 1, len(idx)), start)
            for k in range(len(langs)):
                sums[:, k] += np.diff(
                    np.concatenate([[0], np.cumsum(logs[k, g][idx], dtype=np.int64)])[np.stack([start, end], 1)], axis=1
                )[:, 0]
        post = sums / SCALE + prior
        best = post.argmax(axis=1)
        sure = 1.0 / np.exp(post - post.max(axis=1, keepdims=True)).sum(axis=1)
        for i, k, p in zip(own, best.tolist(), sure.tolist()):
            out_lang[i], out_score[i] = langs[k], p
    return out_lang, out_score


def identify(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with lang_pred and score; `keep`: the columns to pass on (all)."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        langs, scores = score(batch.column(text).to_pylist(), sent.value)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    return arrow_columns(docs, compute, fields, keep)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from: fold 2 of 4, and rows without an id."""
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(True))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()).select("lang", "text"))
    held = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify(held, model, keep=["doc_id", "held_out"])
