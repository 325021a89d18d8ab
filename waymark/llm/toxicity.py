"""Toxicity: a classifier that is regularised by counterfactual identity swaps.

Features are the hashed words that a text has and their beginnings of `PREFIXES` bytes,
for inflected forms (present or absent). Counterfactuals come from two sources: labelled
sentences that name a group, and, as corpora seldom name them, every `INSERT_EVERY`-th
labelled row, into which a term of one of the languages is inserted. In each, the term is
swapped for the others of its set; the fit penalises the squared change of the score, so a
mention of a group does not raise it, whatever the labels of the rows that it stands in.
The number of pairs is reported (`pairs`); with labelled rows and no pair, `learn` fails.

Fitted on at most `max_rows` labelled rows (smallest hash of the id); only features of
`min_docs` rows and more, counted by Spark, or of identity terms are numbered and reach
the driver, and an L1 term leaves few of them, so the weights that are broadcast are
bounded by the sample. Every whole text is scored in Arrow maps as a sparse sum over its
distinct features.

Edge cases: a null or empty text has no words and gets the score of the bias; null
labels and null ids are not learned from; repeated labels of a document count once,
the largest, and of the texts of an id that repeats the least; repeated documents are
scored each; without any label every score is 0.5. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from waymark.llm._common import WordHashes, arrow_columns, as_bytes, fold, materialise, plain_words, prepare, table
from waymark.llm.linear import counterfactual, sigmoid
from waymark.llm.quality import labelled

MAX_ROWS = 16_000
MIN_DOCS = 4
PREFIXES = (4, 5, 6)
#: Terms of a set can stand for one another.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("black", "white", "asian", "hispanic", "african", "european", "latino"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("deaf", "blind", "disabled"),
    ("old", "young", "elderly"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("einwanderer", "flüchtlinge", "ausländer", "bürger"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
)
#: One labelled row in so many gets a term.
INSERT_EVERY = 4
OTHERS = {w.encode(): [x.encode() for x in own if x != w] for own in IDENTITY for w in own}
SENTENCE = re.compile(rb"[.!?\n]+")
_hashes = WordHashes()


def words_of(text: bytes | None) -> set[bytes]:
    return set(plain_words(text))


def forms(word: bytes) -> list[bytes]:
    """The word and its beginnings."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) >= n)]


def features(words: set[bytes] | list[bytes]) -> set[bytes]:
    return {f for w in words for f in forms(w)}


def swaps_of(text: bytes | None) -> list[tuple[list[bytes], list[bytes]]]:
    """Counterfactuals of the sentences that name a group: words that come, words that go."""
    if not text or not (words_of(text) & OTHERS.keys()):
        return []
    return [([new], [w]) for s in SENTENCE.split(text) for w in sorted(words_of(s) & OTHERS.keys()) for new in OTHERS[w]]


def _hashed(feats: set[bytes]) -> np.ndarray:
    return np.sort(_hashes.of(list(feats)))


def learn(rows: DataFrame, penalty: float = 4.0, min_docs: int = MIN_DOCS) -> dict:
    """Weights by feature hash, the bias and the number of pairs, of rows (text, y), a bounded sample."""
    spark = rows.sparkSession
    prepare(spark)
    rows = materialise(rows.select("text", F.col("y").cast("int").alias("y")), "toxicity-sample")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in as_bytes(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(_hashed(features(words_of(t))).view(np.int64))], names=["f"])

    counted = rows.select("text").mapInArrow(emit, "f long").groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    seen = counted.select("f").toArrow().column("f").to_numpy().view(np.uint64)
    sets = [[_hashed(set(forms(w.encode()))) for w in own] for own in IDENTITY]
    known = np.union1d(seen, np.concatenate([f for own in sets for f in own]))
    sent = spark.sparkContext.broadcast(known)

    def number(h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(sent.value, h), len(sent.value) - 1)
        return at[sent.value[at] == h].astype("<i4")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch, "text")
            changes = [[number(_hashed(x)).tobytes() for come, go in swaps_of(t) for x in (features(come) - features(go), features(go) - features(come))] for t in texts]
            made = [pa.array([number(_hashed(features(words_of(t)))).tobytes() for t in texts], pa.binary()), pa.array(changes, pa.list_(pa.binary())), batch.column("y")]
            yield pa.RecordBatch.from_arrays(made, names=["f", "c", "y"])

    got = rows.mapInArrow(featurise, "f binary, c array<binary>, y int").toArrow()
    data = sorted(zip(*(got.column(c).to_pylist() for c in "fcy")), key=lambda r: (r[0], r[2]))
    del got
    feats = [np.frombuffer(f, "<i4") for f, _, _ in data]
    swaps = [(np.frombuffer(c[i], "<i4"), np.frombuffer(c[i + 1], "<i4")) for _, c, _ in data for i in range(0, len(c), 2)]
    terms = [[number(f) for f in own] for own in sets]
    for i in range(0, len(feats), INSERT_EVERY):
        own = terms[i // INSERT_EVERY % len(terms)]
        at = i // INSERT_EVERY // len(terms) % len(own)
        feats[i] = np.union1d(feats[i], own[at]).astype("<i4")
        swaps += [(np.setdiff1d(other, own[at]), np.setdiff1d(own[at], other)) for k, other in enumerate(own) if k != at]
    if feats and not swaps:
        raise ValueError("no counterfactual pair could be built from the labelled rows")
    bounds = np.concatenate([[0], np.cumsum([len(f) for f in feats])]).astype(np.int64)
    flat = np.concatenate(feats) if feats else np.zeros(0, np.int32)
    labels = np.array([float(y > 0) for _, _, y in data])
    w, b = counterfactual(bounds, flat, labels, swaps, len(known), penalty)
    used = np.abs(w) > 1e-3
    return {"bias": float(b), "weights": dict(zip(known[used].tolist(), w[used].tolist())), "pairs": len(swaps)}


class _Known(dict):
    """Of words (bytes), the features that have a weight; kept for the words seen of late."""

    LIMIT, LONGEST = 400_000, 64

    def __init__(self, weights: dict[int, float]) -> None:
        self.weights = weights

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        own = tuple(h for f in forms(word) if (h := xxhash.xxh3_64_intdigest(f)) in self.weights)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = own
        return own

    def margin(self, words: set[bytes]) -> float:
        found = {h for own in map(self.__getitem__, words) if own for h in own}
        return sum(self.weights[h] for h in sorted(found))


def classify(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (its columns `keep`) with the score of each whole text."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    state: dict[str, _Known] = {}

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        if not state:
            state["w"] = _Known(sent.value["weights"])
        out = [state["w"].margin(words_of(t)) for t in as_bytes(batch, text)]
        return [pa.array(sigmoid(np.array(out, float) + sent.value["bias"]), pa.float64())]

    return arrow_columns(docs, compute, [StructField("score", DoubleType())], keep)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id, 5) == 0, F.lit(True))


def op6_toxicity(spark: SparkSession, sf_dir: str, max_rows: int = MAX_ROWS) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(labelled(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out(), max_rows))
    scored = classify(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
