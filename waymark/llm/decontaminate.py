"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters. Each
item gives its windows of 13 consecutive words (a shorter item one window); all
windows form one automaton over the normalised text, in which words are separated by
single spaces, so that a text is scanned once whatever the number of items. Word
positions of the hits map back to offsets of the original text.

The items are broadcast, so their size is checked: items of more than `max_bytes`
are dealt into several automata by a hash of the item, one scan each, whose hits are
merged per document; no item is dropped.

Edge cases: a null or empty text has no words and no hit; null or empty items have no
window; repeated items count once per item_id, a null item_id counts as the text
`null`; repeated documents are reported each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from math import ceil

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm._common import arrow_columns, as_bytes, plain_words, prepare, table

WINDOW = 13
#: Bytes of items in one automaton; the trie takes about 60 times as much.
MAX_BYTES = 4 << 20
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", SPANS),
]
_built: dict[str, ahocorasick.Automaton] = {}


def automaton(items: list[tuple[str, bytes]], window: int = WINDOW) -> ahocorasick.Automaton:
    """All windows of all items; the value is (words of the window, item ids)."""
    owners: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = plain_words(text)
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            key = f" {b' '.join(words[i : i + k]).decode('latin-1')} "
            owners.setdefault(key, (k, set()))[1].add(item)
    auto = ahocorasick.Automaton()
    for key, (k, ids) in owners.items():
        auto.add_word(key, (k, tuple(ids)))
    auto.make_automaton()
    return auto


def scan(text: bytes | None, auto: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], list[str]]:
    """The number of words, the merged runs of hit words, and the items that occur."""
    words = plain_words(text)
    if not words or not len(auto):
        return len(words), [], []
    line = f" {b' '.join(words).decode('latin-1')} "
    runs: list[list[int]] = []
    items: set[str] = set()
    at = last = 0
    for end, (k, ids) in auto.iter(line):
        last += line.count(" ", at, end)  # spaces before the closing one: words so far
        at = end
        items.update(ids)
        first = last - k
        while runs and runs[-1][1] >= first:
            first = min(first, runs.pop()[0])
        runs.append([first, last])
    return len(words), [(a, b) for a, b in runs], sorted(items)


def _spans(text: str, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word runs as code point offsets of the original text, end exclusive."""
    if not runs:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]


def _items(benchmark: DataFrame, item_id: str, text: str, shard: int, shards: int) -> list[tuple[str, bytes]]:
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t"))
    rows = rows.where(F.col("t").isNotNull())
    if shards > 1:
        rows = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == shard)
    return [(r.i, r.t.encode()) for r in rows.distinct().collect()]


def report(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_bytes: int = MAX_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """`docs` (its columns `keep`) with n_words, n_hit, items and spans.

    Columns of `docs` that have one of these names are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in FIELDS}]
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    shards = max(1, ceil(size / max_bytes))

    def scanned(shard: int, source: DataFrame, kept: list[str]) -> DataFrame:
        items = _items(benchmark, item_id, item_text, shard, shards)
        key = hashlib.sha256(repr((window, sorted(items))).encode()).hexdigest()
        sent = spark.sparkContext.broadcast(items)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            if key not in _built:
                _built.clear()
                _built[key] = automaton(sent.value, window)
            auto, n, hit, ids, spans = _built[key], [], [], [], []
            for t in as_bytes(batch, text):
                words, runs, items = scan(t, auto)
                n.append(words)
                hit.append(sum(b - a for a, b in runs))
                ids.append(items)
                spans.append([{"start": a, "end": b} for a, b in runs] if shards > 1 else _spans(t.decode(), runs) if runs else [])
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))]
            return [pa.array(x, k) for x, k in zip((n, hit, ids, spans), kinds)]

        return arrow_columns(source, compute, FIELDS, kept)

    if shards == 1:
        return scanned(0, docs, keep)
    return _merged(docs, text, keep, [scanned(s, docs.select(F.xxhash64(text).alias("__h"), text), ["__h", text]) for s in range(shards)])


def _merged(docs: DataFrame, text: str, keep: list[str], parts: list[DataFrame]) -> DataFrame:
    """Hits of several automata: word runs are united per distinct text."""
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = hits.where("n_hit > 0").groupBy("__h", F.col(text).alias("__t")).agg(
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.flatten(F.collect_set("spans")).alias("runs")
    )
    own = docs.select(*keep, F.col(text).alias("__t")).withColumn("__h", F.xxhash64("__t"))
    joined = own.join(hits, ["__h", "__t"], "left")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        n, hit, ids, spans = [], [], [], []
        for t, items, runs in zip(as_bytes(batch, "__t"), batch.column("items").to_pylist(), batch.column("runs").to_pylist()):
            merged: list[list[int]] = []
            for a, b in sorted((r["start"], r["end"]) for r in runs or []):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            n.append(len(plain_words(t)))
            hit.append(sum(b - a for a, b in merged))
            ids.append(sorted(items or []))
            spans.append(_spans(t.decode(), [(a, b) for a, b in merged]) if merged else [])
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))]
        return [pa.array(x, k) for x, k in zip((n, hit, ids, spans), kinds)]

    return arrow_columns(joined, compute, FIELDS, keep)


def contaminated():
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = report(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        "spans",
    )
