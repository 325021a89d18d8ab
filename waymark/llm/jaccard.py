"""N-gram Jaccard join: candidates must share prefix tokens under several global orders.

Sets are the distinct 3-word shingles of a text, as 64-bit tokens: 58 bits of hash below
6 bits of the shingle's length, the longest first. Two sets of sizes m and n with
Jaccard >= t share, under any global order of tokens, one of their first
m - ceil(t m) + 1 tokens; so a pair that shares none under one of the orders is none.
All orders put tokens last that are frequent (a count sketch of fixed size, filled by
all documents, says which); then order A goes by the token, so that long, rare forms
come first, and orders B and C by two independent hashes of it.

1. Equal sets make a class (`node`), so copies are never paired. Only nodes go on.
2. Prefix tokens of order A that two or more nodes share (an aggregate) give buckets of
   narrow rows: token, node, size, position. First each member meets one leader of its
   bucket only: the member with the largest share of tokens that others have too, which
   is the original of a group of edited copies.
3. A pair stays if sizes and positions leave room for the overlap, if the parity
   sketches (1024 bits) do not prove too large a symmetric difference (each differing
   bit needs a token that one set lacks), and if the prefixes of orders B and C, looked
   up once per distinct pair, intersect. What is left is verified on the whole sets,
   made again from the texts of the nodes of such pairs alone.
4. Links contract to components (label propagation, each round written). Then every pair
   of a bucket whose members are in different components goes through step 3, with
   sizes, positions and parity as the condition of one join. So groups of copies cost
   about one pair per member, near misses are not made as rows, and no link between
   components is lost. Sort-merge joins on the token let Spark split hot buckets.

Edge cases: a null or empty text, or one without words, has n_shingles 0 and links
with nothing; a text of fewer than three words is one shingle; repeated rows share a
class and a component; rows that share an id with different texts are sets of their own,
which links name by that id; a null id never names a component unless all its ids are
null; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm._common import BASE, Scratch, Words, as_bytes, bitmap, has_bits, mix, prepare, slices, table

WIDTH = 3
#: Jaccard threshold, in hundredths.
PERCENT = 90
#: Counters of the sketch: 1 byte each in the broadcast, whatever the corpus.
COUNTERS = 1 << 22
CHUNKS = 64
#: Longs of a parity sketch.
PARITY = 16
LEADER_ROUNDS = 1
#: Bytes of texts that are worked on at once.
SLICE = 1 << 20
#: What tells the hash orders B and C apart.
SALTS = {"b": np.uint64(0x632BE59BD9B4E019), "c": np.uint64(0x8CB92BA72F3D8DD7)}
PARITIES = [f"p{i}" for i in range(PARITY)]


def shingle_sets(texts: list[bytes], width: int = WIDTH, distinct: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of each text, one text after the other, and the bounds of each text.

    Distinct and ascending in each text, or else each occurrence as it comes.
    """
    w = Words(texts, lower=True)
    count = np.diff(w.bounds)

    def token(at: np.ndarray, k: int) -> np.ndarray:
        h, size = np.full(len(at), k, np.uint64), np.zeros(len(at), np.int64)
        for i in range(k):
            h = h * BASE + w.hashes[at + i]
            size += w.lengths[at + i]
        return (mix(h) >> np.uint64(6)) | ((63 - np.minimum(size, 63)).astype(np.uint64) << np.uint64(58))

    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    owner = np.repeat(np.arange(len(texts)), made)
    at = np.arange(bounds[-1]) - bounds[owner] + w.bounds[owner]
    size = np.minimum(count, width)[owner]
    out = np.zeros(len(at), np.uint64)
    for k in range(1, width + 1):
        own = size == k
        if own.any():
            out[own] = token(at[own], k)
    if not distinct or not len(out):
        return out, bounds
    for a, b in zip(bounds[:-1], bounds[1:]):
        out[a:b].sort()
    keep = np.concatenate([[True], out[1:] != out[:-1]])
    keep[bounds[:-1][made > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(20)).astype(np.int64) & (COUNTERS - 1)


def frequency_levels(docs: DataFrame, text: str = "text", width: int = WIDTH) -> np.ndarray:
    """Per counter: 0 for up to 4 times the mean (or 64), else how many doublings more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            texts = as_bytes(batch, "t")
            for a, b in slices([len(t) for t in texts], SLICE):
                np.add.at(own, _counter(shingle_sets(texts[a:b], width, distinct=False)[0]), np.uint32(1))
        parts = [zlib.compress(p.tobytes(), 1) for p in np.split(own, CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=["c", "v"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS // CHUNKS, np.uint64)
        for batch in batches:
            for v in batch.column("v").to_pylist():
                total += np.frombuffer(zlib.decompress(v), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["c", "v"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInArrow(count, "c int, v binary")
    got = rows.groupBy("c").applyInArrow(add, "c int, v binary").collect()
    if not got:
        return np.zeros(COUNTERS, np.uint8)
    total = np.concatenate([np.frombuffer(r.v, np.uint64) for r in sorted(got, key=lambda r: r.c)]).astype(float)
    base = max(64.0, 4 * total.mean())
    return np.minimum(np.ceil(np.log2(np.maximum(total, base) / base)), 31).astype(np.uint8)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - (-(-percent * n // 100)) + 1


def _first(key: np.ndarray, p: int) -> np.ndarray:
    """Which of the keys are the p least ones; equal keys count as one."""
    return key <= np.partition(key, p - 1)[p - 1] if p < len(key) else np.ones(len(key), bool)


def _lists(own: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(own) if own else np.zeros(0), kind))


def signatures(docs: DataFrame, levels: np.ndarray, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n, k1 and k2 (digest of the set), prefixes a, b, c, parity p0 to p15."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    kind = docs.schema[doc_id].dataType.simpleString()

    def signed(texts: list[bytes]) -> tuple:
        tokens, bounds = shingle_sets(texts, width)
        size = np.diff(bounds)
        owner = np.repeat(np.arange(len(texts)), size)
        hashed = {k: mix(tokens ^ salt) for k, salt in SALTS.items()}
        level = sent.value[_counter(tokens)].astype(np.uint64) << np.uint64(59)
        keys = {"a": level | (tokens >> np.uint64(5))} | {k: level | (h >> np.uint64(5)) for k, h in hashed.items()}
        lists: dict[str, list[np.ndarray]] = {k: [] for k in keys}
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            p = prefix_size(hi - lo, percent)
            own = keys["a"][lo:hi]
            at = np.flatnonzero(_first(own, p))
            lists["a"].append(tokens[lo:hi][at[np.argsort(own[at])]].view(np.int64))
            for k, h in hashed.items():
                lists[k].append(h[lo:hi][_first(keys[k][lo:hi], p)].astype(np.uint32).view(np.int32))
        digest = np.zeros((2, len(texts)), np.uint64)
        some = size > 0
        if some.any():
            digest[0, some] = np.add.reduceat(hashed["b"], bounds[:-1][some]) + size[some].astype(np.uint64) * BASE
            digest[1, some] = np.bitwise_xor.reduceat(mix(hashed["c"]), bounds[:-1][some])
        bits = np.bincount(owner * (64 * PARITY) + (hashed["b"] >> np.uint64(54)).astype(np.int64), minlength=64 * PARITY * len(texts)) & 1
        parity = np.packbits(bits.astype(np.uint8)).view("<i8").reshape(len(texts), PARITY)
        return size, digest.view(np.int64), lists, parity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch, "t")]
            for lo, hi in slices([len(t) for t in texts], SLICE):
                size, digest, lists, parity = signed(texts[lo:hi])
                arrays = [batch.column("doc_id").slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(digest[0]), pa.array(digest[1])]
                arrays += [_lists(lists["a"], pa.int64()), _lists(lists["b"], pa.int32()), _lists(lists["c"], pa.int32())]
                arrays += [pa.array(np.ascontiguousarray(parity[:, i])) for i in range(PARITY)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "k1", "k2", "a", "b", "c", *PARITIES])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    fields = f"doc_id {kind}, n long, k1 long, k2 long, a array<long>, b array<int>, c array<int>, " + ", ".join(f"{p} long" for p in PARITIES)
    return rows.mapInArrow(run, fields)


def _sizes(percent: int) -> Column:
    """What the sizes nx and ny leave."""
    return F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent


def _positions(percent: int) -> Column:
    """What the places posx and posy of a shared token leave: i >= t (n + m) / (1 + t)."""
    # one token more than the places allow: keys of order A have 59 bits and may tie
    room = F.least("posx", "posy") + 2 + F.least(F.col("nx") - F.col("posx"), F.col("ny") - F.col("posy")) - 1
    return room * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent


def _parity(percent: int) -> Column:
    """|x ^ y| = n + m - 2 i, and the sketches show at least so many differing tokens."""
    apart = reduce(lambda s, c: s + c, (F.bit_count(F.col(f"{p}x").bitwiseXOR(F.col(f"{p}y"))) for p in PARITIES))
    return apart * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent)


def _side(rows: DataFrame, side: str, columns: list[str], key: str | None = None) -> DataFrame:
    return rows.select(*(F.col(c).alias(side if c == key else c + side) for c in columns))


class _Join:
    """The state of one join: nodes, buckets, links, components."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, percent: int, width: int) -> None:
        self.docs, self.doc_id, self.text, self.percent, self.width = docs, doc_id, text, percent, width
        prepare(docs.sparkSession)
        self.scratch = Scratch(docs.sparkSession, "jaccard")
        levels = frequency_levels(docs, text, width)
        wide = self.scratch.write(signatures(docs, levels, doc_id, text, percent, width), "signatures")
        self.rows = self.scratch.write(wide.select("doc_id", "n", "k1", "k2"), "rows")
        held = ["n", "a", "b", "c", *PARITIES]
        nodes = wide.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in held))
        self.nodes = self.scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        self.scratch.drop("signatures")
        tokens = self.nodes.select("node", F.col("n").cast("int").alias("n"), F.size("a").alias("tokens"), F.posexplode("a").alias("pos", "token"))
        shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
        self.buckets = self.scratch.write(tokens.join(shared, "token"), "buckets")
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None  # node, label of every node that has a link

    def placed(self) -> DataFrame:
        """Buckets with the component of each member; only those with two or more."""
        rows = self.buckets.drop("tokens")
        if self.labels is None:
            return rows.withColumn("label", F.col("node"))
        rows = rows.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
        return rows.join(mixed, "token", "left_semi")

    def leaders(self, number: int) -> DataFrame:
        """Distinct pairs of each member with one leader of its bucket, of another component."""
        share = self.buckets.groupBy("node").agg((F.count("*") * 1000 / F.first("tokens")).cast("int").alias("share"))
        rows = self.placed().join(share, "node")
        order = F.struct("share", F.xxhash64("node", F.lit(number)))
        lead = rows.groupBy("token").agg(F.max_by(F.struct(F.col("node").alias("y"), "label", "n", "pos"), order).alias("l"))
        met = rows.join(lead, "token").select(
            F.col("node").alias("x"), "l.y", F.col("label").alias("labelx"), F.col("l.label").alias("labely"),
            F.col("n").alias("nx"), F.col("l.n").alias("ny"), F.col("pos").alias("posx"), F.col("l.pos").alias("posy"),
        )
        pairs = met.where((F.col("labelx") != F.col("labely")) & _sizes(self.percent) & _positions(self.percent)).select("x", "y").distinct()
        signed = ["node", "n", *PARITIES]
        known = pairs.join(_side(self.nodes, "x", signed, "node"), "x").join(_side(self.nodes, "y", signed, "node"), "y")
        return known.where(_parity(self.percent)).select("x", "y", "nx", "ny")

    def rest(self) -> DataFrame:
        """Every distinct pair of a bucket across components that its bounds allow."""
        signed = self.placed().join(self.nodes.select("node", *PARITIES), "node")
        columns = ["token", "node", "n", "pos", "label", *PARITIES]
        x, y = (_side(signed, s, columns) for s in "xy")
        # the bounds are part of the join's condition: pairs that fail are never made as rows
        met = x.join(
            y,
            (F.col("tokenx") == F.col("tokeny"))
            & (F.col("nodex") < F.col("nodey"))
            & (F.col("labelx") != F.col("labely"))
            & _sizes(self.percent)
            & _positions(self.percent)
            & _parity(self.percent),
        )
        return met.select(F.col("nodex").alias("x"), F.col("nodey").alias("y"), "nx", "ny").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (x, y), those that link: orders B and C, then the whole sets."""
        pairs = self.scratch.write(pairs, "pairs")
        orders = ["node", "b", "c"]
        both = pairs.join(_side(self.nodes, "x", orders, "node"), "x").join(_side(self.nodes, "y", orders, "node"), "y")
        kept = self.scratch.write(both.where(F.arrays_overlap("bx", "by") & F.arrays_overlap("cx", "cy")).select("x", "y", "nx", "ny"), "kept")
        sets = self.scratch.write(self._sets(kept.select(F.col("x").alias("node")).union(kept.select("y")).distinct()), "sets")
        full = kept.join(_side(sets, "x", ["node", "s"], "node"), "x").join(_side(sets, "y", ["node", "s"], "node"), "y")
        common = F.size(F.array_intersect("sx", "sy"))
        return full.where(common * 100 >= (F.col("nx") + F.col("ny") - common) * self.percent).select("x", "y")

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """node, s: the sets of some nodes, of those texts alone whose id may be one of theirs."""
        width = self.width
        ids = self.nodes.select("node", "id", "k1", "k2").join(wanted, "node")
        sent = self.docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("id").alias("h")), "h"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.filter(pa.array(has_bits(sent.value, batch.column("h").to_numpy().view(np.uint64))))
                texts = as_bytes(own, "t")
                for lo, hi in slices([len(t) for t in texts], SLICE):
                    tokens, bounds = shingle_sets(texts[lo:hi], width)
                    some = np.diff(bounds) > 0
                    starts = bounds[:-1][some]
                    hashed = {k: mix(tokens ^ salt) for k, salt in SALTS.items()}
                    k1 = np.add.reduceat(hashed["b"], starts) + np.diff(bounds)[some].astype(np.uint64) * BASE if len(starts) else tokens
                    k2 = np.bitwise_xor.reduceat(mix(hashed["c"]), starts) if len(starts) else tokens
                    s = pa.ListArray.from_arrays(pa.array(np.append(starts, len(tokens)), pa.int32()), pa.array(tokens.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), s], names=["k1", "k2", "s"])

        texts = self.docs.where(F.col(self.text).isNotNull()).select(F.xxhash64(self.doc_id).alias("h"), F.col(self.text).alias("t"))
        found = texts.mapInArrow(run, "k1 long, k2 long, s array<long>")
        return ids.select("node", "k1", "k2").join(found, ["k1", "k2"]).groupBy("node").agg(F.first("s").alias("s"))

    def contract(self, links: DataFrame) -> None:
        """Adds links and relabels: each node gets the least node of its component."""
        links = links if self.links is None else self.links.unionByName(links)
        self.links = self.scratch.write(links, "links")
        edges = self.links.union(self.links.select("y", "x")).toDF("node", "other")
        labels = self.scratch.write(edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
        while True:
            near = edges.join(labels.select(F.col("node").alias("other"), F.col("label").alias("l")), "other").groupBy("node").agg(F.min("l").alias("l"))
            hop = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))  # the label's own label: doubles the reach
            least = F.least("label", "l", F.coalesce("far", "label"))
            new = labels.join(near, "node").join(hop, "label", "left").select("node", least.alias("label"), (least < F.col("label")).alias("moved"))
            new = self.scratch.write(new, "labels")
            moved = new.where("moved").limit(1).count()
            labels = new.select("node", "label")
            if not moved:
                break
        self.labels = labels

    def result(self) -> DataFrame:
        found = self.nodes.select("k1", "k2", "node", "id").join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = found.groupBy("label").agg(F.min("id").alias("component_id"))
        named = found.join(least, "label").select("k1", "k2", "component_id")
        out = self.rows.where("n > 0").join(named, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        return out.unionByName(self.rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    join = _Join(docs, doc_id, text, percent, width)
    for number in range(LEADER_ROUNDS):
        join.contract(join.verified(join.leaders(number)))
    join.contract(join.verified(join.rest()))
    join.scratch.drop("buckets", "pairs", "kept", "sets", "links")
    return join.result()


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
