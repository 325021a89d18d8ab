"""Ranked lexical search: an inverted index in shards of documents, searched by MaxScore.

Index: each task turns its documents into shards of about `shard_terms` terms, without an
exchange. A shard has a row per term (documents by number, occurrences) and one row
with its documents' ids and lengths. It is written to the shared folder and answers any
number of searches.

Search: the items come in blocks of bounded size, so their terms and weights can be
broadcast; corpus-wide counts come from the index. A shard's rows of the block's terms
meet in one task. For each item its terms are sorted by upper bounds (the largest
contribution in the shard). The lists of largest bounds are added up until the bounds of
all others together stay below the k-th best score so far: those others are non-essential,
no document that is in them alone can qualify. They are then probed by binary search, for
the documents only whose score with all bounds still ahead reaches the k-th best. A bound
that ties with it goes on, as ids decide ties. A shard yields at most k rows an item; the
best k of all shards are kept by a rank window, which limits groups before its exchange.

All scores are whole numbers, as the weights are, so results do not depend on the order
of addition.

Edge cases: a null text, or one without terms, has no postings and is not counted; such an
item has no rows; texts of one item id are one item; documents that repeat an id are
judged each and may fill several ranks; null ids come first among equal scores; terms of
weight 0 add nothing; an empty table on either side gives no rows. Other columns are
ignored. A text of any length stays whole, in one shard.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from waymark.llm._common import Scratch, as_bytes, plain_words, prepare, slices, table

#: Terms (with repeats) after which a shard is full.
SHARD_TERMS = 2_000_000
#: Bytes of item texts that are searched at once; their terms and weights are broadcast.
BLOCK_BYTES = 8 << 20
K = 10


class _Numbers(dict):
    """Terms by number, in order of appearance."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shard_terms: int = SHARD_TERMS) -> DataFrame:
    """Rows `shard`, `term`, `docs`, `counts`, `ids`; of a shard's null term: its documents' lengths as `counts`, and ids.

    Written to the shared folder: shards are named by the tasks that made them.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[doc_id].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        numbers, ids, keys, lengths, total = _Numbers(), [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal numbers, ids, keys, lengths, total, made
            terms = list(numbers)
            order = sorted(range(len(terms)), key=terms.__getitem__)
            place = np.empty(len(terms), np.int64)
            place[order] = np.arange(len(terms))
            all_keys = np.concatenate(keys)
            found, counts = np.unique((place[all_keys >> 32] << 32) | (all_keys & 0xFFFFFFFF), return_counts=True)
            starts = np.searchsorted(found >> 32, np.arange(len(terms) + 1)).astype(np.int32)
            postings = (found & 0xFFFFFFFF).astype(np.int32)
            n = len(terms)
            # one more row, of the null term, with no postings but the documents themselves
            doc_ends = np.append(starts, starts[-1])
            count_ends = np.append(starts, starts[-1] + len(lengths))
            id_ends = np.append(np.zeros(n + 1, np.int32), len(ids)).astype(np.int32)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + 1, first + made)),
                    pa.array([*(terms[i].decode("utf-8") for i in order), None], pa.string()),
                    pa.ListArray.from_arrays(pa.array(doc_ends), pa.array(postings)),
                    pa.ListArray.from_arrays(pa.array(count_ends.astype(np.int32)), pa.array(np.concatenate([counts, lengths]).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(id_ends), pa.array(ids, arrow)),
                ],
                names=["shard", "term", "docs", "counts", "ids"],
            )
            numbers, ids, keys, lengths, total = _Numbers(), [], [], [], 0
            made += 1
            return out

        for batch in batches:
            for i, raw in zip(batch.column("id").to_pylist(), as_bytes(batch, "text")):
                words = plain_words(raw)
                if words:
                    own = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                    keys.append((own << 32) | len(ids))
                    ids.append(i)
                    lengths.append(len(words))
                    total += len(words)
                    if total >= shard_terms:
                        yield close()
        if ids:
            yield close()

    schema = f"shard long, term string, docs array<int>, counts array<int>, ids array<{kind.simpleString()}>"
    made = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)
    return Scratch(docs.sparkSession, "search").write(made, "index", "zstd")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def contributions(counts: np.ndarray, lengths: np.ndarray, own_weight: int) -> np.ndarray:
    """What postings add to a score: occurrences in documents of (normalised) lengths."""
    tf = counts.astype(np.int64)
    return own_weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * lengths))


def normalised(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Lengths against the mean one, in whole numbers of any size."""
    own, at = np.unique(lengths, return_inverse=True)
    return np.array([10 + (90 * int(n) * n_docs) // n_terms for n in own], np.int64)[at]


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest, 0 of fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def max_score(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of which the best k are the best of all (ties with the k-th included).

    `lists` has documents (ascending) and contributions of each term.
    """
    lists = sorted(((int(c.max()), d, c) for d, c in lists), key=lambda x: -x[0])
    ahead = sum(x[0] for x in lists)
    total = np.zeros(n_docs, np.int64)
    best, i = 0, 0
    while i < len(lists) and ahead >= best:  # essential lists
        bound, d, c = lists[i]
        total[d] += c
        ahead -= bound
        i += 1
        best = max(best, kth(total[d], k))
        if ahead < 4 * best:
            best = max(best, kth(total, k))
    open_ = np.flatnonzero(total)
    scores = total[open_]
    for bound, d, c in lists[i:]:  # non-essential lists
        best = max(best, kth(scores, k))
        can = scores + ahead >= best
        open_, scores = open_[can], scores[can]
        at = np.minimum(np.searchsorted(d, open_), len(d) - 1)
        hit = d[at] == open_
        scores[hit] += c[at[hit]]
        ahead -= bound
    can = scores >= max(1, kth(scores, k))
    return open_[can], scores[can]


def _search_block(found: DataFrame, items: list[tuple[object, list[str]]], item_kind: str, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """The best k documents of each shard for each item of a block."""
    spark = found.sparkSession
    terms = spark.createDataFrame([(t,) for t in sorted({t for _, own in items for t in own})], "term string")
    hits = found.join(F.broadcast(terms), "term", "left_semi")
    weights = {r.term: weight(n_docs, r.df) for r in hits.groupBy("term").agg(F.sum(F.size("docs")).alias("df")).collect()}
    shared = spark.sparkContext.broadcast((items, weights))
    kind = found.schema["ids"].dataType.elementType
    arrow_id, arrow_item = to_arrow_type(kind), to_arrow_type(spark.createDataFrame([], f"i {item_kind}").schema["i"].dataType)
    names = ["item_id", "doc_id", "score"]

    def run(shard: pa.Table) -> pa.Table:
        own_items, own_weights = shared.value
        columns = [shard.column(c).combine_chunks() for c in ("term", "docs", "counts", "ids")]
        at = {t: i for i, t in enumerate(columns[0].to_pylist())}
        row = lambda c, t: columns[c][at[t]].values
        ids, lengths = row(3, None), normalised(row(2, None).to_numpy(), n_docs, n_terms)
        lists = {}
        for t in at:
            if t is not None and own_weights[t] > 0:
                d = row(1, t).to_numpy()
                lists[t] = d, contributions(row(2, t).to_numpy(), lengths[d], own_weights[t])
        out: list[tuple] = []
        for item, own in own_items:
            docs, scores = max_score([lists[t] for t in own if t in lists], len(lengths), k)
            told = zip(scores.tolist(), ids.take(pa.array(docs)).to_pylist())
            for s, d in heapq.nsmallest(k, told, key=lambda x: (-x[0], x[1] is not None, x[1])):
                out.append((item, d, s))
        cols = list(zip(*out)) if out else [()] * 3
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (arrow_item, arrow_id, pa.int64()))], names=names)

    of_block = found.where("term is null").unionByName(hits)
    return of_block.groupBy("shard").applyInArrow(run, f"item_id {item_kind}, doc_id {kind.simpleString()}, score long")


def search(found: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`item_id`, `rank`, `doc_id`, `score` of the best k documents of an index for each item."""
    spark = items.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    facts = found.where("term is null").agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    joined = items.where(F.col(text).isNotNull()).groupBy(F.col(item_id).alias("item")).agg(F.array_join(F.sort_array(F.collect_list(text)), " ").alias("text"))
    parts, block, size = [], [], 0

    def close() -> None:
        nonlocal block, size
        if block and facts.n:
            parts.append(_search_block(found, block, kind, k, facts.n, facts.l))
        block, size = [], 0

    for r in joined.orderBy("item").toLocalIterator():
        own = sorted({w.decode() for w in plain_words(r.text.encode())})
        if size and size + len(r.text) > block_bytes:
            close()
        if own:
            block.append((r["item"], own))
            size += len(r.text)
    close()
    every = spark.createDataFrame([], f"item_id {kind}, doc_id {found.schema['ids'].dataType.elementType.simpleString()}, score long")
    for p in parts:
        every = every.unionByName(p)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
d AS (SELECT r, doc_id, w, len(w) AS n FROM words WHERE len(w) > 0),
facts AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
occurrences AS (SELECT r, doc_id, n, unnest(w) AS term FROM d),
p AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM occurrences WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM p, facts GROUP BY term, nd),
scores AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN weights USING (term), facts GROUP BY item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
